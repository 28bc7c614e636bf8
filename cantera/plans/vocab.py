"""Vocabularies and word lists that decide results.

Fixed values: every list, table and number below has to be exactly this for the
results to be right; the order of a vocabulary breaks ties between equal scores.
"""

from __future__ import annotations

PRIMARY_GENRES = (
    "Rock", "Pop", "Indie", "Hip-Hop", "Electronic", "Jazz", "Blues", "Classical", "Country",
    "Folk", "R&B", "Metal", "Punk", "Reggae", "Latin", "Soul", "Dance",
)

SUB_GENRES = (
    "Americana", "Southern Rock", "Country Rock", "Alt-Country", "Roots Rock", "Alternative Rock",
    "Hard Rock", "Heavy Metal", "Thrash Metal", "Hardcore Punk", "Crossover Thrash", "Pop-Punk",
    "Post-Hardcore", "Death Metal", "Black Metal", "Power Metal", "Doom Metal", "Stoner Rock",
    "Indie Folk", "Lo-Fi", "Trip-Hop", "Grunge", "Indie Rock", "Indie Pop", "Classic Rock",
    "Rockabilly", "Oldies", "Rock and Roll", "Folk Rock", "Pop Rock", "Psychedelic Rock",
    "British Invasion", "Prog Rock", "Punk Rock", "Art Rock", "Glam Rock", "New Wave", "Post-Punk",
    "Acoustic Rock", "Soft Rock", "Skate Punk", "Garage Rock", "Disco", "Funk", "House", "EDM",
    "Techno", "Club", "Dance-Pop", "Rap", "Reggaeton", "Ska", "Synthpop", "Synthwave", "Neo-Soul",
    "Motown", "Afrobeat", "Dub", "Groove", "Bluegrass", "Blues Rock", "Electric Blues",
    "Chicago Blues", "Delta Blues", "Chamber Music", "Symphonic", "Singer-Songwriter",
    "Electropop", "Trance", "Electronica", "IDM", "Ambient", "Dubstep", "Drum and Bass",
    "Slowcore", "Post-Rock", "Sadcore", "Darkwave", "Gothic", "Shoegaze", "Emo", "Ballad",
)

#: Used where the configured list of moods is empty.
MOOD_TAGS = (
    "Party", "Chill Hang", "Energetic", "Groovy", "Acoustic", "Electronic", "Melancholic", "Lively",
    "Relaxed", "Romantic", "Calm", "Upbeat", "Dark", "Happy", "Fun", "Celebration", "Festive",
    "Mellow", "Feel-Good", "Friendly", "Intense", "Driving", "Powerful", "Aggressive", "Rowdy",
    "Funky", "Rhythmic", "Soulful", "Smooth", "Unplugged", "Intimate", "Organic", "Warm",
    "Hypnotic", "Futuristic", "Atmospheric", "Sad", "Bittersweet", "Somber", "Brooding", "Gloomy",
    "Emotional",
)

#: The first 22 are the matcher's own default, all 27 the configured one.
CONFIGURED_MOODS = (
    "party", "chill hang", "energetic", "groovy", "acoustic", "electronic", "melancholic", "upbeat",
    "dark", "happy", "relaxed", "aggressive", "romantic", "calm", "mellow", "lively", "funky",
    "intense", "hypnotic", "atmospheric", "bittersweet", "intimate", "heavy", "nostalgic", "trippy",
    "soulful", "moody",
)
MATCHER_MOODS = CONFIGURED_MOODS[:22]

GENRE_MOOD_SEEDS = {
    "Punk Rock": ("Rowdy", "Aggressive"),
    "Skate Punk": ("Rowdy", "Aggressive"),
    "Hardcore": ("Aggressive", "Heavy"),
    "Hard Rock": ("Heavy",),
    "Heavy Metal": ("Heavy", "Aggressive", "Intense"),
    "Grunge": ("Heavy", "Dark"),
    "Dance-Pop": ("Party", "Upbeat"),
    "Disco": ("Party", "Groovy"),
    "Funk": ("Groovy", "Funky"),
    "Funk Rock": ("Groovy", "Funky"),
    "Ska": ("Upbeat",),
    "Ska Punk": ("Rowdy", "Upbeat"),
    "Classical": ("Atmospheric", "Calm"),
    "Baroque": ("Atmospheric", "Calm"),
    "Chamber Music": ("Calm", "Mellow"),
    "Symphonic": ("Atmospheric", "Intense"),
    "Opera": ("Atmospheric", "Intense", "Romantic"),
    "Soft Rock": ("Mellow", "Relaxed"),
    "Acoustic Rock": ("Acoustic", "Mellow"),
    "Singer-Songwriter": ("Acoustic", "Melancholic"),
    "Slowcore": ("Melancholic", "Dark"),
    "Sadcore": ("Melancholic", "Dark"),
    "Emo": ("Melancholic",),
    "Motown": ("Soulful", "Groovy"),
    "Neo-Soul": ("Soulful", "Groovy"),
    "Psychedelic Rock": ("Trippy", "Atmospheric"),
    "Indie Rock": ("Chill Hang",),
    "Indie Pop": ("Chill Hang",),
    "Indie Folk": ("Chill Hang", "Acoustic"),
    "Lo-Fi": ("Chill Hang", "Mellow"),
    "Americana": ("Chill Hang",),
    "Alternative Rock": ("Chill Hang",),
}

PRIMARY_STEMS = {
    "Punk": ("punk", "hardcore punk", "street punk", "skate punk", "post-punk"),
    "Metal": ("metal", "heavy metal", "thrash", "death metal", "black metal", "doom metal"),
    "Rock": ("rock", "rock and roll", "rock n roll", "rockabilly", "classic rock"),
    "Pop": ("pop", "dance-pop", "synthpop", "electropop"),
    "Hip-Hop": ("hip-hop", "hip hop", "rap", "hiphop", "trap", "gangsta rap"),
    "Electronic": (
        "electronic", "electronica", "techno", "house", "trance", "edm", "synthwave", "dubstep", "dnb",
        "drum and bass", "ambient", "club",
    ),
    "Jazz": ("jazz", "bebop"),
    "Blues": ("blues", "delta blues", "chicago blues"),
    "Country": ("country", "alt-country", "bluegrass", "americana"),
    "Folk": ("folk", "indie folk", "americana"),
    "R&B": ("r&b", "rnb", "rhythm and blues"),
    "Soul": ("soul", "motown", "neo-soul"),
    "Reggae": ("reggae", "dub", "ska"),
    "Latin": ("latin", "reggaeton", "salsa", "bossa nova"),
    "Dance": ("dance", "club", "edm", "house"),
    "Classical": ("classical", "symphonic", "chamber music", "baroque", "opera"),
    "Indie": ("indie", "indie rock", "indie pop", "indie folk", "lo-fi"),
}

SUB_STEMS = {
    "Punk Rock": ("punk rock", "punk"),
    "Rap": ("rap", "hip hop", "hip-hop", "hiphop"),
    "Thrash Metal": ("thrash", "thrash metal"),
    "Hardcore Punk": ("hardcore punk",),
    "Rockabilly": ("rockabilly", "rock and roll", "rock n roll"),
    "Oldies": ("oldies",),
}

NATIONALITIES = ("american", "british", "australian", "canadian", "german", "french", "japanese", "english")
#: Words in the first three tags that let "indie" stand for the style.
INDIE_CONTEXT = {
    "Indie Rock": ("rock", "garage"),
    "Indie Pop": ("pop", "dance"),
    "Indie Folk": ("folk", "acoustic"),
}
MODIFIERS = (
    "indie", "rock", "pop", "metal", "punk", "folk", "country", "alternative", "post", "garage", "soft", "hard",
)
EXCLUSIVE_STYLES = (
    ("Soft Rock", "Hard Rock"),
    ("Soft Rock", "Heavy Metal"),
    ("Soft Rock", "Punk Rock"),
    ("Acoustic Rock", "Hard Rock"),
    ("Acoustic Rock", "Heavy Metal"),
    ("Acoustic Rock", "Punk Rock"),
    ("Pop Rock", "Heavy Metal"),
)
#: Tags too general to name a mood through their vector; a sub-genre also not through "punk".
GENERIC_FOR_VECTORS = (
    "rock", "pop", "metal", "jazz", "blues", "country", "folk", "rap", "hip hop", "hiphop", "electronic", "dance",
)
GENERIC_PRIMARY = (*GENERIC_FOR_VECTORS, "punk")
NEEDS_KEYWORD = ("acoustic", "electronic")

GENRE_KEYWORDS = (
    "rock", "punk", "metal", "hardcore", "pop", "jazz", "blues", "folk", "country", "classical", "hiphop",
    "hip hop", "rap", "electronic", "techno", "house", "indie", "alternative", "reggae", "ska", "grunge",
    "synthpop", "instrumental",
)
MOOD_KEYWORDS = (
    "party", "dance", "club", "lively", "fun", "celebration", "festive", "hangout", "chill", "mellow",
    "feel-good", "friendly", "upbeat", "relaxed", "calm", "energetic", "intense", "driving", "powerful",
    "aggressive", "hardcore", "thrash", "nyhc", "metalcore", "grindcore", "rowdy", "groovy", "funky",
    "rhythmic", "soulful", "boogie", "smooth", "acoustic", "unplugged", "intimate", "organic", "warm",
    "romantic", "electronic", "synth", "hypnotic", "futuristic", "atmospheric", "melancholic", "sad",
    "bittersweet", "somber", "brooding", "gloomy", "emotional", "happy", "dark", "heavy", "space",
    "summer", "ballad", "dream", "inspiring", "motivational", "cool",
)
BOILERPLATE = (
    "chicago", "american", "us", "uk", "british", "english", "australian", "canadian", "german", "french",
    "japanese", "seen live", "live", "favorites", "favourite", "favorite", "love", "heard on", "pandora",
    "spotify", "playlist", "track", "song", "album", "artist", "music", "singer", "songwriter", "band",
    "great", "nice", "awesome", "good", "cool", "mp3", "tag", "recommend", "soundtrack", "ost", "theme",
    "version", "remix", "cover",
)
CORE_KEYWORDS = (
    "rock", "pop", "hip-hop", "hip hop", "rap", "gangsta rap", "reggae", "jazz", "blues", "metal",
    "classical", "electronic", "country", "folk", "punk", "soul", "r&b",
)
PUNK_STYLES = ("punk rock", "hardcore punk", "post-hardcore", "skate punk", "pop-punk")
METAL_STYLES = ("heavy metal", "thrash metal", "death metal", "black metal", "doom metal", "power metal")

ROWDY_MOODS = ("energetic", "heavy", "aggressive", "intense", "dark", "rowdy")
ROWDY_STYLES = (
    "hard rock", "heavy metal", "thrash metal", "hardcore punk", "post-hardcore", "grunge", "punk rock", "skate punk",
)
#: (present, dropped), applied one after the other to what is left.
MOOD_CONFLICTS = (
    (("acoustic", "mellow", "meditative", "calm"), ("heavy", "aggressive", "rowdy")),
    (
        ("heavy", "aggressive", "rowdy", "intense", "hardcore", "dark"),
        ("chill hang", "groovy", "relaxed", "calm", "mellow", "romantic", "happy", "upbeat"),
    ),
    (("heavy", "aggressive", "dark", "melancholic"), ("happy", "upbeat")),
    (("heavy", "aggressive", "dark"), ("romantic",)),
    (("energetic", "lively"), ("melancholic",)),
)

AUDIO_LABEL_MOODS = {
    "sexy": "Romantic", "love": "Romantic", "sad": "Melancholic", "ballad": "Melancholic",
    "emotional": "Melancholic", "relaxing": "Relaxed", "meditative": "Calm", "soft": "Mellow",
    "heavy": "Heavy", "party": "Party", "fun": "Party", "dark": "Dark", "dramatic": "Dark",
    "happy": "Happy", "positive": "Happy", "groovy": "Groovy", "energetic": "Energetic",
    "upbeat": "Upbeat", "inspiring": "Upbeat", "motivational": "Upbeat", "hopeful": "Upbeat",
    "epic": "Atmospheric", "dream": "Atmospheric",
}
AUDIO_GENERIC_LABELS = (
    "fast", "lively", "slow", "background", "commercial", "advertising", "corporate", "film", "movie",
    "documentary", "game", "trailer",
)
AUDIO_SUPPORT_MOODS = (
    "aggressive", "heavy", "party", "upbeat", "groovy", "melancholic", "mellow", "romantic", "dark", "calm", "happy",
)

ARTIST_SEPARATORS = (" feat", " ft.", " with ", " & ", " and ", " / ", ", ", " x ", " vs ", " vs. ")

"""cantera: a Spark-native engine for enriching music catalogues.

Every operator is a function from DataFrames to DataFrames; the caller decides
when to run it. What a user of the library needs first can be imported from here.
"""

from importlib import import_module

__version__ = "0.2.0"

_EXPORTS = {
    "enrich": "cantera.plans.enrich", "Features": "cantera.plans.enrich", "report": "cantera.plans.enrich", "run_summary": "cantera.plans.enrich",
    "Vocabulary": "cantera.operators.matcher", "match_tags": "cantera.operators.matcher", "map_tags": "cantera.operators.matcher",
    "match_lists": "cantera.operators.matcher", "with_similarity": "cantera.operators.embedding", "Embedder": "cantera.operators.embedding",
    "AudioModel": "cantera.operators.audio", "audio_moods": "cantera.operators.audio", "tempo": "cantera.operators.audio",
    "page_tags": "cantera.sources.payloads", "recording_tags": "cantera.sources.payloads", "release_tags": "cantera.sources.payloads",
    "fetch": "cantera.sources.remote", "read_export": "cantera.sources.catalog", "catalog_edits": "cantera.operators.sinks",
    "single_mood": "cantera.operators.sinks", "push": "cantera.operators.sinks", "frame_writes": "cantera.operators.merge",
    "mood_command": "cantera.operators.merge", "StateStore": "cantera.operators.state",
}
__all__ = list(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(import_module(_EXPORTS[name]), name)

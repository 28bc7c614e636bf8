"""Live look-ups at a limited rate, for sources that have no stored answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


class Busy(Exception):
    """Raised by a fetcher when the service asks to come back later."""


def fetch(
    keys: DataFrame,
    call: Callable[[dict], str | None],
    spacing: float = 3.5,
    retries: int = 2,
    pause: float = 4.0,
    lanes: int = 1,
) -> DataFrame:
    """``keys`` with the column ``body``: the answer for each distinct row, null if none.

    ``lanes`` tasks call at the same time, so the service sees ``lanes / spacing``
    calls a second at most. A busy service is asked again up to ``retries`` times;
    any other failure is no answer.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields) + ", body string"

    def run(batches: Iterator) -> Iterator:
        last = 0.0
        for pdf in batches:
            bodies = []
            for row in pdf.to_dict("records"):
                body = None
                for attempt in range(retries + 1):
                    time.sleep(max(0.0, last + spacing - time.monotonic()))
                    last = time.monotonic()
                    try:
                        body = call(row)
                    except Busy:
                        if attempt < retries:
                            time.sleep(pause)
                            continue
                    except Exception:  # noqa: BLE001 - no answer
                        body = None
                    break
                bodies.append(body)
            yield pdf.assign(body=bodies)

    return keys.distinct().repartition(lanes).mapInPandas(run, schema)

"""Reviews from a provider that answers in pages or later. The call itself is the
user's: a function from a request to (status, payload); nothing here opens a connection."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .reviews import normalise_reviews, unwrap_payload

#: Seconds between asking again for an answer that isn't ready: the first, its growth, the most, and in all.
DELAY, GROWTH, MOST_DELAY, MOST_WAIT = 3.0, 1.5, 15.0, 300.0
Call = Callable[[dict], tuple[int, dict]]


def wait_for(call: Call, request: dict, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The payload once the provider has it (status 202 means not yet)."""
    waited, delay = 0.0, DELAY
    while True:
        status, payload = call(request)
        if status == 200 and payload.get("status", "Success") != "Pending":
            return payload
        if status not in (200, 202):
            raise OSError(f"the provider answered {status}")
        if waited >= MOST_WAIT:
            raise TimeoutError(f"no answer within {MOST_WAIT:.0f} seconds")
        sleep(min(delay, MOST_WAIT - waited))
        waited += delay
        delay = min(delay * GROWTH, MOST_DELAY)


def pages(call: Call, request: dict, most: int = 100, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Payloads page by page, following ``next_page_token``, ``most`` at most."""
    for _ in range(most):
        payload = wait_for(call, request, sleep)
        yield payload
        token = payload.get("next_page_token")
        if not token:
            return
        request = {**request, "page_token": token}


def fetch(spark: SparkSession, call: Call, request: dict, now: str, **kwargs) -> DataFrame:
    """Normalised reviews of all pages of one place, whose payloads the driver gets."""
    rows = [(json.dumps(p),) for p in pages(call, request, **kwargs)]
    return normalise_reviews(unwrap_payload(spark.createDataFrame(rows, "raw string")), now)

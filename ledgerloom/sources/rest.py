"""A paginated REST source as a Python data source."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import CONTRACT, FIELDS

ATTEMPTS, BACKOFF_S, MOST_DELAY_S, PAGE_ROWS = 5, 1.0, 300.0, 100


class Number(str):
    """A JSON number as it was written."""


def shown(value: object) -> str:
    """A value as messages show it."""
    return str(value) if isinstance(value, Number) else repr(value)


def as_received(record: dict) -> tuple[list[str], dict[str, str]]:
    """(its keys but the surrogate id, the values of text fields that are no text): what the contract has to see of a record beside its texts."""
    texts = [f for f, rules in CONTRACT["properties"].items() if rules["type"] == "string" and f != "transaction_date"]
    other = {f: shown(record[f]) for f in texts if record.get(f) is not None and (isinstance(record[f], Number) or not isinstance(record[f], str))}
    return [k for k in record if k != "id"], other


def query(offset: int, start: str | None, inclusive: bool, limit: int = PAGE_ROWS) -> str:
    """Ascending by date and then id, so that equal dates have one order; the mark is pushed to the server."""
    params = {"order": "transaction_date.asc,transaction_id.asc", "limit": limit, "offset": offset}
    if start:
        params["transaction_date"] = ("gte." if inclusive else "gt.") + start
    return urlencode(params)


def fetch(url: str, api_key: str, backoff: float = BACKOFF_S) -> list[dict]:
    """One page; server and network errors are tried again, each time after twice the wait."""
    for attempt in range(ATTEMPTS):
        try:
            with urlopen(Request(url, headers={"apikey": api_key, "Authorization": f"Bearer {api_key}"}), timeout=60) as answer:
                return json.loads(answer.read(), parse_float=Number, parse_int=Number)
        except (HTTPError, URLError) as e:
            if attempt + 1 == ATTEMPTS or isinstance(e, HTTPError) and e.code < 500 and e.code != 429:
                raise
            time.sleep(min(MOST_DELAY_S, backoff * 2**attempt))
    raise AssertionError("unreachable")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # offsets follow from the page before: where pages end is not known in advance

    def read(self, _: InputPartition) -> Iterator[tuple]:
        o, offset = self.options, 0
        limit = int(o.get("limit", PAGE_ROWS))
        while page := fetch(f"{o['url']}?{query(offset, o.get('start'), o.get('inclusive', 'true') == 'true', limit)}", o["apikey"], float(o.get("backoff", BACKOFF_S))):
            for record in page:
                yield (*(None if record.get(f) is None else str(record[f]) for f in FIELDS), *as_received(record), offset + 1)
                offset += 1
            if len(page) > limit:
                raise ValueError("a page holds more rows than asked for")


class RestTransactions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_transactions"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in FIELDS) + ", record_keys array<string>, record_other map<string,string>, batch_seq long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_rest(spark: SparkSession, url: str, api_key: str | None, start: str | None = None, inclusive: bool = True, **options: str) -> DataFrame:
    if not api_key:
        raise ValueError("the REST source needs an API key (--api-key)")
    spark.dataSource.register(RestTransactions)
    reader = spark.read.format("rest_transactions").options(url=url, apikey=api_key, inclusive=str(inclusive).lower(), **options)
    return (reader.option("start", start) if start else reader).load()

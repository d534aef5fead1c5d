"""Paginated record API as a Spark data source: one partition per page range is not known ahead, so a reader walks
its organisation's pages; organisations and entities are partitions and load in parallel."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY = {429, 500, 502, 503, 504}


def fetch_json(url: str, timeout: float = 30.0, retries: int = 3, backoff: float = 0.5) -> dict:
    for k in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY or k == retries:
                raise
        except urllib.error.URLError:
            if k == retries:
                raise
        time.sleep(backoff * 2**k)
    raise AssertionError


def pages(get, base: str, key: str, per_page: int = 200):
    """Records of all pages until the source says that there are no more."""
    page = 1
    while True:
        body = get(f"{base}{'&' if '?' in base else '?'}page={page}&per_page={per_page}")
        yield from body.get(key) or []
        if not (body.get("page_context") or {}).get("has_more_page"):
            return
        page += 1


class PagedRecords(DataSource):
    """``spark.read.format("paged_records").option("urls", json list of [org, entity, url])``: (org, entity, record JSON)."""

    @classmethod
    def name(cls):
        return "paged_records"

    def schema(self):
        return "source_org_key string, entity_name string, raw_json string"

    def reader(self, schema):
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options.get("urls", "[]"))

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        org, entity, url = partition.value
        for record in pages(fetch_json, url, entity):
            yield org, entity, json.dumps(record)


# fixed values: entities whose pages hold summaries only, with the id and the key of a detail
DETAILS = {"bills": ("bill_id", "bill"), "expenses": ("expense_id", "expense")}
GONE = {404, 410}
DETAIL_SCHEMA = "source_org_key string, entity_name string, raw_json string, detail string"


def with_details(records: DataFrame, urls: dict[str, str], tasks: int, get=fetch_json) -> DataFrame:
    """Records of ``paged_records`` with each summary of ``DETAILS`` replaced by its detail, fetched from ``urls[organisation]/entity/id``.

    The second step of two: write the records first, or pages are walked again when a task is repeated. Records are dealt to
    ``tasks`` readers, which bounds how many ask at once. ``get`` repeats answers of ``RETRY``; what fails for good fails the task.
    ``detail``: ``full``; ``summary`` where the source has no detail or the record has no id, and then the summary stays; null for other
    entities."""

    def run(batches):
        for pdf in batches:
            texts, kinds = [], []
            for org, entity, raw in zip(pdf["source_org_key"], pdf["entity_name"], pdf["raw_json"]):
                kind = None
                if entity in DETAILS:
                    raw, kind = _detail(get, urls.get(org), entity, raw)
                texts.append(raw)
                kinds.append(kind)
            yield pdf.assign(raw_json=texts, detail=kinds)[["source_org_key", "entity_name", "raw_json", "detail"]]

    return records.select("source_org_key", "entity_name", "raw_json").repartition(tasks).mapInPandas(run, DETAIL_SCHEMA)


def _detail(get, base: str | None, entity: str, raw: str | None) -> tuple[str | None, str]:
    id_field, key = DETAILS[entity]
    record = json.loads(raw) if raw else None
    id_ = record.get(id_field) if isinstance(record, dict) else None
    if not id_ or not base:
        return raw, "summary"
    try:
        body = get(f"{base}/{entity}/{urllib.parse.quote(str(id_), safe='')}")
    except urllib.error.HTTPError as e:
        if e.code not in GONE:
            raise
        return raw, "summary"
    detail = body.get(key)
    return (json.dumps(detail), "full") if detail else (raw, "summary")

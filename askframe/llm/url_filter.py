"""URL filter as a sort-merge range join.

A host is turned round label by label and closed with a dot (``www.example.com`` -> ``com.example.www.``), so a rule's
host and all its subdomains are one interval of keys: everything that starts with the rule's key. Pages are cut into cells
of key ranges (bounds from a bounded sample, ties split by a hash of the page, so a hot host covers several cells); a rule
is copied only to the cells its interval meets. Each cell is sorted and swept once, with a stack of the rules whose
intervals are open; nested hosts nest on the stack. Memory per task is the stack, not the cell.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .common import arrow_schema, ascii_lower, partitions

OUT = "page_id {id}, host string, path string, rule string, verdict string"
#: Keys looked at for the cell bounds, per cell. The sample moves bounds only; no result depends on it.
SAMPLE_PER_CELL = 20


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url. Null, or without ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(batches: Iterator[pa.RecordBatch], default: str, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell, key and kind (rules first). The stack holds [key, {length: {path: (rule, action)}}]."""
    cell, stack = None, []
    for batch in batches:
        got: dict[str, list] = {n: [] for n in out.names}
        for c, key, kind, page, host, path, action in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if c != cell:
                cell, stack = c, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append([key, {}])
                at = stack[-1][1].setdefault(len(path), {})
                if path not in at or action == "block":
                    at[path] = (host + path, action)
                continue
            best: tuple = (-1, -1, None, default)
            for k, by_length in stack:
                for n, rules in by_length.items():
                    if (hit := rules.get(path[:n])) and (len(hit[0]), len(k)) > best[:2]:
                        best = (len(hit[0]), len(k), *hit)
            for n, v in zip(out.names, (page, host, path, best[2], best[3]), strict=True):
                got[n].append(v)
        yield pa.RecordBatch.from_pydict(got, schema=out)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every page. pages: page_id, url; rules: rule_host, rule_path, action ('block' or 'allow').

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest rule (host plus path)
    wins, then the longer host, then block. Defined cases: null or malformed urls get empty host and path and the default
    verdict; repeated pages come back once each; rules with a null or empty host are ignored; a null rule path is empty;
    empty tables give an empty result or default verdicts; further columns of either table are not looked at.
    """
    spark = pages.sparkSession
    ship(spark)
    host, path = split_url(F.col("url"))
    base = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    base = base.withColumn("key", F.concat(host_key(F.col("host")), F.lit("\x01"), F.col("path"), F.lit("\x01"), F.hex(F.xxhash64("page_id"))))
    cells = partitions(spark)
    picked = sorted(r[0] for r in base.select("key").orderBy(F.xxhash64("key")).limit(SAMPLE_PER_CELL * cells).collect())
    bounds = sorted({picked[i * len(picked) // cells] for i in range(1, cells)}) if picked else []

    @F.pandas_udf("int")
    def cell(k: pd.Series) -> pd.Series:
        return k.map(lambda x: bisect_right(bounds, x)).astype("int32")

    @F.pandas_udf("array<int>")
    def cells_of(k: pd.Series) -> pd.Series:
        return k.map(lambda x: list(range(bisect_right(bounds, x), bisect_left(bounds, x[:-1] + "/") + 1)))

    r = rules.filter("rule_host <> ''").select(ascii_lower(F.col("rule_host")).alias("host"), F.coalesce("rule_path", F.lit("")).alias("path"), "action").distinct()
    r = r.withColumn("key", host_key(F.col("host")))
    kind = pages.schema["page_id"].dataType
    both = base.select(cell("key").alias("cell"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("action")).unionByName(
        r.select(F.explode(cells_of("key")).alias("cell"), "key", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("page_id"), "host", "path", "action")
    )
    schema = OUT.format(id=kind.simpleString())
    out = arrow_schema(spark, schema)
    return both.repartition(cells, "cell").sortWithinPartitions("cell", "key", "kind").mapInArrow(lambda it: _sweep(it, default, out), schema)

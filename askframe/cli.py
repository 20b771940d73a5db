"""python -m askframe.cli introspect|doctor|ask|eval|serve DIR [REQUEST or CASES] [--as-of DATE]: over a folder of Parquet tables.

CASES is a JSON list of cases (id, request, outcomes, gold, must_not, compare, answers); golds are SQL over the tables' names.
"""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from .functions.periods import Clock
from .language.composer import Composer
from .language.harness import evaluate, load_cases
from .server import serve
from .sources.catalog import parquet_frames
from .sources.conventions import build_model
from .sources.doctor import doctor
from .sources.lockfile import write_lockfile


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=("introspect", "doctor", "ask", "eval", "serve"))
    p.add_argument("folder")
    p.add_argument("request", nargs="?")
    p.add_argument("--as-of", default=datetime.now().strftime("%Y-%m-%d"))
    p.add_argument("--lock")
    p.add_argument("--port", type=int, default=8080)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    frames = parquet_frames(spark, a.folder)
    model = build_model(frames)
    if a.command == "introspect":
        for t in model.tables.values():
            print(t.name, f"key {','.join(t.pk) or '-'}", f"time {t.default_time or '-'}", *(f"{c.name}:{c.role}" for c in t.columns.values()))
        if a.lock:
            write_lockfile(a.lock, model)
    elif a.command == "doctor":
        print(*doctor(model), sep="\n")
    if a.command in ("introspect", "doctor"):
        return 0
    composer = Composer(model, frames, Clock(datetime.fromisoformat(a.as_of)))
    if a.command == "eval":
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        return evaluate(composer, load_cases(a.request), lambda q: [tuple(r) for r in spark.sql(q).collect()])
    if a.command == "serve":
        serve(composer, port=a.port).serve_forever()
    if a.command == "ask":
        r = composer.compose(a.request or "")
        print(r.outcome, r.narrative or r.reason or f"{r.clarification.question} {r.clarification.options}")
        for row in composer.execute(r) if r.outcome == "execute" else []:
            print(*row, sep="\t")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

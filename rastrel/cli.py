"""Command line: `python -m rastrel.cli classify-first|primitive-first IMAGE...` draws files, `serve` starts the service.

Every setting of an order is a flag; --config reads them from a YAML or JSON file first. One file is drawn on the spot,
several or a folder by Spark."""

from __future__ import annotations

import argparse
import json
import types
import typing
from dataclasses import fields
from pathlib import Path

from rastrel.config import ClassifyFirst, Common, PrimitiveFirst
from rastrel.utils import default_output, load_yaml

ORDERS = {"classify-first": ClassifyFirst, "primitive-first": PrimitiveFirst}


def _kind(annotation) -> type:
    """The type of a setting that may be None."""
    if isinstance(annotation, types.UnionType):
        return next(a for a in typing.get_args(annotation) if a is not type(None))
    return annotation


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rastrel")
    orders = out.add_subparsers(dest="order", required=True)
    for name, settings in ORDERS.items():
        own = orders.add_parser(name)
        own.add_argument("inputs", nargs="+", help="image files, or a folder of them")
        own.add_argument("--output", help="SVG file, or a folder for several inputs")
        own.add_argument("--config", help="YAML or JSON file of settings")
        hints = typing.get_type_hints(settings)
        for f in fields(settings):
            kind = _kind(hints[f.name])
            flag = "--" + f.name.replace("_", "-")
            if kind is bool:
                own.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
            else:
                own.add_argument(flag, type=kind, default=None)
    serve = orders.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--pipeline", choices=sorted(ORDERS), default="classify-first")
    return out


def settings_of(args: argparse.Namespace) -> Common:
    """Settings by file, then by flags."""
    order = ORDERS[args.order]
    values: dict = {}
    if args.config:
        text = Path(args.config)
        values = json.loads(text.read_text()) if text.suffix == ".json" else load_yaml(text)
    values |= {f.name: getattr(args, f.name) for f in fields(order) if getattr(args, f.name) is not None}
    return order.from_dict(values)


def draw_file(path: str, output: Path, settings: Common) -> dict:
    """One file's SVG, written; the statistics of its document."""
    from rastrel.kernels import document
    from rastrel.streaming.jobs import document_of

    found = document_of(Path(path).read_bytes(), settings)
    output.parent.mkdir(parents=True, exist_ok=True)
    output.write_text(document.export(found, settings.background), encoding="utf-8")
    return {"input": str(path), "output": str(output), **document.statistics(found)}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.order == "serve":
        from rastrel.service import Jobs, serve

        serve(Jobs(ORDERS[args.pipeline]()), args.host, args.port).serve_forever()
        return 0
    settings = settings_of(args)
    if len(args.inputs) == 1 and Path(args.inputs[0]).is_file():
        path = args.inputs[0]
        print(json.dumps(draw_file(path, Path(args.output) if args.output else default_output(path, args.order), settings)))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from rastrel.streaming.jobs import run_jobs

    spark = SparkSession.builder.getOrCreate()
    files = spark.read.format("binaryFile").load(args.inputs).select("path", "content")
    folder = args.output or str(default_output("x", args.order).parent)
    rows = run_jobs(files, settings)
    rows.write.mode("overwrite").parquet(f"{folder}/jobs")
    done = spark.read.parquet(f"{folder}/jobs")
    print(json.dumps({"output": f"{folder}/jobs", **done.agg(F.count("*").alias("jobs"), F.sum(F.col("ok").cast("int")).alias("completed")).first().asDict()}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

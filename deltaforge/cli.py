"""Command line: ``python -m deltaforge.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

HELP = """compress BASE DERIVED OUT           store a model as its difference from another
reconstruct BASE DELTA OUT          rebuild it
compress-lossy BASE DERIVED OUT     the same by low-rank factors (--rank)
reconstruct-lossy BASE DELTA OUT
dataset-compress BASE DERIVED OUT   store a dataset as references into another and new rows
dataset-reconstruct BASE DELTA OUT
dataset-estimate BASE DERIVED       what that would save
info DELTA                          an artifact's manifest
Models are folders or files of safetensors, or Parquet in block or long form; datasets are Parquet with an id column."""


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="deltaforge", description=HELP, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--master")
    sub = top.add_subparsers(dest="command", required=True)
    for name, places in (("compress", ("base", "derived", "out")), ("reconstruct", ("base", "delta", "out")), ("compress-lossy", ("base", "derived", "out")), ("reconstruct-lossy", ("base", "delta", "out")), ("dataset-compress", ("base", "derived", "out")), ("dataset-reconstruct", ("base", "delta", "out")), ("dataset-estimate", ("base", "derived")), ("info", ("delta",)), ("help", ())):
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place)
        if name == "compress":
            p.add_argument("--mode", choices=("smart", "basic", "full"), default="smart")
        if name == "reconstruct":
            p.add_argument("--strict", action="store_true")
        if name == "compress-lossy":
            p.add_argument("--rank", type=int, default=16)
        if name.startswith("dataset"):
            p.add_argument("--order", default="id")
            p.add_argument("--splits", nargs="*", default=[])
            p.add_argument("--match", choices=("id", "content"), default="id")
            p.add_argument("--sample", type=int, default=1000)
    return top


def _rows(spark, path: str, a):
    from deltaforge.operators.dataset import number

    rows = spark.read.parquet(path)
    return rows if "pos" in rows.columns else number(rows, [a.order], a.splits)


def _long(spark, path: str):
    from deltaforge.model import to_long
    from deltaforge.sources.tensors import load_tensors

    return to_long(load_tensors(spark, path))


def _shapes(spark, path: str):
    """First dimensions of the matrices among the layers."""
    from pyspark.sql import functions as F

    from deltaforge.sources.tensors import shapes

    found = shapes(spark, path)
    if found is None:
        raise ValueError(f"{path}: the layers' shapes aren't known; save models by save_tensors, with their shapes")
    return found.where(F.size("shape") >= 2).select("layer", F.col("shape")[0].alias("rows"))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "help":
        print(HELP)
        return 0
    from deltaforge.cache import rebuild
    from deltaforge.operators import dataset as ds
    from deltaforge.plans import artifact, lossy
    from deltaforge.session import session
    from deltaforge.sources.tensors import load_tensors

    spark = session(a.master)
    say = lambda what, share: print(f"{share:4.0%} {what}")
    try:
        if a.command == "compress":
            m = artifact.compress_model(load_tensors(spark, a.base), load_tensors(spark, a.derived), a.out, a.base, a.derived, a.mode, report=say)
            print(f"{m['num_layers']} layers, {m['compression_ratio']:.2f} times smaller")
        elif a.command == "reconstruct":
            rebuild(load_tensors(spark, a.base), a.delta, a.strict).write.mode("overwrite").parquet(a.out)
        elif a.command == "compress-lossy":
            m = lossy.compress_model_svd(_long(spark, a.base), _long(spark, a.derived), _shapes(spark, a.base), a.out, a.rank, a.base, a.derived)
            print(f"rank {m['rank']}, {m['compression_ratio']:.2f} times smaller")
        elif a.command == "reconstruct-lossy":
            lossy.reconstruct_model_svd(_long(spark, a.base), a.delta).write.mode("overwrite").parquet(a.out)
        elif a.command == "dataset-compress":
            m = artifact.compress_dataset(_rows(spark, a.base, a), _rows(spark, a.derived, a), a.out, a.splits, a.match, a.base, a.derived)
            print(f"{m['savings_percent']:.1f} % saved")
        elif a.command == "dataset-reconstruct":
            artifact.reconstruct_dataset(_rows(spark, a.base, a), a.delta, a.splits).write.mode("overwrite").parquet(a.out)
        elif a.command == "dataset-estimate":
            print(json.dumps(ds.estimate(_rows(spark, a.base, a), _rows(spark, a.derived, a), a.sample).first().asDict()))
        else:
            m = artifact.read_manifest(spark, a.delta)
            print(json.dumps({k: v for k, v in m.items() if k != "layers"}, indent=1))
            for x in m.get("layers", []):
                print(f"{x['method']:7} {x['numel']:>12} {x['layer']}")
    except Exception as e:
        print(f"{type(e).__name__}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

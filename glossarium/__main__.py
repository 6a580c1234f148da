"""python -m glossarium -corpus_dir DIR -train_dir DIR -test_dir DIR -save_dir DIR [-reset features|classifier|full ...] [-predict] [-eval]

Results are printed whole, a tab-separated line for each row.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .plans.cache import Config
from .plans.engine import Engine


def _print(name: str, table: DataFrame) -> None:
    print(f"# {name}")
    print("\t".join(table.columns))
    for row in table.toLocalIterator():  # a partition at a time
        print("\t".join("" if x is None else str(x) for x in row))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    for name, folder in (("corpus", "Dev"), ("train", "Train"), ("test", "Test"), ("save", "Save")):
        p.add_argument(f"-{name}_dir", default=folder)
    p.add_argument("-reset", nargs="+", choices=["features", "classifier", "full"], default=[])
    p.add_argument("-predict", action="store_true")
    p.add_argument("-eval", action="store_true")
    p.add_argument("-dimensions", type=int, default=100)
    p.add_argument("-iterations", type=int, default=500)
    p.add_argument("-booster", choices=["leaves", "levels"], default="leaves")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("glossarium").getOrCreate()
    engine = Engine(spark, Config(a.corpus_dir, a.train_dir, a.test_dir, a.save_dir), a.dimensions, a.iterations, a.booster)
    if "full" in a.reset:
        engine.clear()
    engine.train("features" in a.reset, "classifier" in a.reset)
    if a.predict:
        _print("predictions", engine.predict().orderBy("noun", "verb"))
    if a.eval:
        for name, table in engine.evaluate().items():
            _print(name, table)


if __name__ == "__main__":
    main()

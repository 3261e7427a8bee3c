"""python -m scrivane COMMAND ...: small jobs from a shell.

scan IN.parquet OUT [--key doc_id --text text]   hits of a text column
features PICTURES OUT                            81 features of a tree of pictures
score FEATURES MODEL.json OUT                    label chances from a feature table and a tree model
query NAME SF_DIR OUT                            a registered query
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="scrivane", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("scan", ("table", "out")), ("features", ("pictures", "out")), ("score", ("table", "model", "out")), ("query", ("name", "sf_dir", "out"))):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        if name == "scan":
            c.add_argument("--key", default="doc_id")
            c.add_argument("--text", default="text")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "scan":
        from .operators import text

        out = text.pii_hits(spark.read.parquet(a.table), a.key, a.text)
    elif a.command == "features":
        from .operators import images
        from .sources import files

        out = images.feature_vector(images.features(files.read_images(spark, a.pictures)))
    elif a.command == "score":
        from .operators import gbdt
        from .sources import files

        model = gbdt.Model.load(Path(a.model).read_text())
        table = files.wide(spark.read.parquet(a.table))
        out = gbdt.score(table, model, [c for c in table.columns if c[0] == "f" and c[1:].isdigit()]).select("id", *model.trees)
    else:
        from .plans import catalog

        out = catalog.queries()[a.name](spark, a.sf_dir)
    out.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()

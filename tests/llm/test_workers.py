"""Operators run where the workers have no copy of this package."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from revsieve.llm import bpe, decontaminate, line_rules, near_copies, ppm, ranking_quality, substring
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
text = " ".join(f"word{{i}} and" for i in range(60))
df = spark.createDataFrame([(i, text + " end" * (i % 2), "s") for i in range(6)], "doc_id long, text string, source string")
items = spark.createDataFrame([(1, text[100:400])], "item_id long, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
out = [bpe.encode_decode(df, bpe.default_path()), decontaminate.with_leaks(df, items), line_rules.apply_rules(df), near_copies.near_classes(df),
       ppm.scored(df), ranking_quality.ranked(df, df, labels), substring.without_repeats(df)]
print("rows", [x.count() for x in out])
"""


def test_operators_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows [6, 6, 6, 6, 6, 6, 6]" in done.stdout, done.stdout + done.stderr[-3000:]

"""The models reach workers that cannot import the package: a session started outside the repository folder."""

import os
import subprocess
import sys

import scrubline

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as contract
from pyspark.sql import SparkSession, functions as F
from scrubline.llm import context_mixing, language_id, quality

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
words = {"en": "the ship came back to the harbour before night", "fr": "le navire est revenu au port avant la nuit"}
docs = spark.createDataFrame([(i, words["en" if i % 2 else "fr"] + f" {i}", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
model = quality.train(docs, labels, F.lit(True))
assert model is not None and quality.score(docs, model).count() == 40
net = language_id.train(docs, F.lit(True))
assert net is not None and language_id.predict(docs, net).where("lang_pred = lang").count() > 0
assert context_mixing.score(docs).where("score < 0").count() == 40
print("all scored")
"""


def test_workers_need_no_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(scrubline.__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all scored" in done.stdout, done.stderr[-3000:]

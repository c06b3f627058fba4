"""What a Python worker holds while it waits for its next task."""

import os
import subprocess
import sys

RUN = """
import tempfile
from pyspark.sql import SparkSession
import public_tokenizers as vocabularies
from tidegrid.llm import bpe

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def held(batches):
    import pyarrow as pa
    for _ in batches:
        mb = next(int(x.split()[1]) // 1024 for x in open("/proc/self/status") if x.startswith("RssAnon"))
        yield pa.RecordBatch.from_pydict({"mb": [mb]})

docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
bpe.digests(docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN).write.format("noop").mode("overwrite").save()
print("HELD", spark.range(1).mapInArrow(held, "mb long").first()["mb"])
"""


def test_a_worker_that_encoded_gives_its_memory_back():
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", RUN], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": repo})
    assert int(done.stdout.split("HELD")[1]) < 120, done.stdout

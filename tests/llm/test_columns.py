"""Extra columns named like the columns an operator makes for itself."""

from pyspark.sql import functions as F

from depuse.llm import bbit_minhash, surrogates
from tests.llm.helpers import documents, frame

NAMES = ["_again", "_text_hash", "_n", "_key", "_salt", "_hot", "text_hash", "kind", "form", "special"]


def clashing(spark):
    rows = [r for r in documents(n=40) if r[0] is not None]
    rows += [(900 + k, f"Mail ann{k}@example.org or 10.0.0.{k}, says Mr. John Smith", "xx", "s", 1) for k in range(5)]
    return frame(spark, rows).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})


def held(df):
    return sorted(tuple(r[c] for c in ["doc_id", *NAMES]) for r in df.collect())


def test_surrogates_keep_them(spark):
    docs = clashing(spark)
    assert held(surrogates.pseudonymise(docs)) == held(docs)


def test_near_duplicates_keep_them(spark):
    docs = clashing(spark)
    kept = bbit_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    plain = bbit_minhash.one_of_each(docs.select("doc_id", "text"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in plain.collect())
    assert set(held(kept)) <= set(held(docs))

"""Odd tables through all operators on documents and the pipeline: nulls in any column, empty and very long
texts, ties, repeated rows, empty tables, ids of other types and extra columns with clashing names."""

import json
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notelattice.llm import factorisation, hilbert, jaccard_join, language, merkle, mixing, pii, piece_model, quality_rules, token_counts, toxicity, webp

LONG = "a long text of many words and\n some lines number "
GOOD = "they walked along the river and talked of the days when all of them were young and free"
BAD = "buy ### now *** cheap &&& click %%% here $$$ or not <<< >>> and buy it all again today"
TEXTS = [
    None, "", " ", "\n\n", "é 漢字 \U0001f600 \u0085 \u3000 ▁", "x" * 70_000, " ".join(f"{LONG}{i}" for i in range(6000)), GOOD, GOOD, BAD, BAD, GOOD + " indeed",
    "mail a.b@c.de or +1 (030) 555-1234", "you idiot", None, "\"", "0" * 3000, "a@" * 2000,
]
#: Names that operators use for columns of their own.
CLASHING = (
    "trusted_id", "l_id", "d_id", "y", "d", "h", "i", "p", "th", "k1", "k2", "n", "v", "c", "comp", "block", "blocks", "hashes", "links", "rank", "hilbert", "tie", "slice", "cell", "at",
    "total", "shard", "slot", "u", "w", "k", "marks", "text_hash", "size", "source_size", "target", "copies", "taken", "epochs", "ahead", "txt", "s", "good", "gram", "bucket", "llr", "kept",
    "weights", "score", "held_out", "predicted", "media", "ids", "spans", "n_tokens", "m", "r", "no", "nth", "r_id", "r_th", "r_no", "__row", "word", "x", "f", "label", "quality", "toxic",
    "g", "extra", "salt", "part", "kind", "lo", "to_h", "above", "root", "tops", "level", "j", "b_g", "bucket", "lang_pred", "leaf",
)
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
OPERATORS = {
    "op1": lambda d, l: factorisation.score_quality(d, l), "op2": lambda d, l: hilbert.shard(d), "op3": lambda d, l: webp.media_digests(d), "op4": lambda d, l: pii.find_pii(d),
    "op5": lambda d, l: piece_model.encode_texts(d, PIECES), "op6": lambda d, l: jaccard_join.jaccard_join(d), "op7": lambda d, l: mixing.mix(d), "op8": lambda d, l: toxicity.score_toxicity(d, l),
    "op9": lambda d, l: token_counts.token_counts(d, BPE), "op10": lambda d, l: quality_rules.quality_rules(d, l),
    "op12": lambda d, l: language.identify_language(d), "op13": lambda d, l: merkle.merkle_manifest(d),
}
#: Columns that equal texts share, whatever their ids.
SHARED = {
    "op3": ("payload_sha256", "media_sha256", "media_bytes", "feature"), "op4": ("base_sha256", "spans"), "op5": ("ids", "parity"), "op6": ("class_id", "group_id", "n_links"),
    "op8": ("score",), "op9": ("n_tokens",), "op10": ("kept", "llr", "n_words"), "op2": ("size", "text_crc32"), "op7": ("size",), "op12": ("lang_pred", "score"),
}


def tables(spark, kind):
    rows = [(None if i in (3, 8) else i - i % 2 if i in (9, 10) else i, t, "en" if i % 3 else None, ("a", "b", None)[i % 3], None if i == 4 else len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[11]] * 3 + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({c: F.lit(k).cast("long") if k % 2 else F.lit("z") for k, c in enumerate(CLASHING)})
    marks = [(7, 1, 0), (9, 0, 1), (11, 1, 0), (11, 0, 0), (13, 0, 1), (None, 1, 1), (4, None, None), (6, 1, 0), (12, 0, 1), (999, 1, 1), (8, 0, 1)]
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    for kind in ("long", "int", "string"):
        if kind == "string" and name == "op6":
            continue  # class ids are whole numbers
        docs, labels = tables(spark, kind)
        rows = OPERATORS[name](docs, labels).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if kind == "long":
            again = OPERATORS[name](docs.repartition(5), labels).collect()
            assert Counter(map(str, rows)) == Counter(map(str, again))
            text_of = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None}
            same = defaultdict(set)
            for r in rows:
                if r["doc_id"] is not None and r["doc_id"] != 8:
                    same[text_of[r["doc_id"]]].add(json.dumps([r[c] for c in SHARED.get(name, ())], default=str))
            assert name == "op6" or all(len(v) == 1 for v in same.values())
    assert OPERATORS[name](docs.limit(0), labels).count() == 0
    assert OPERATORS[name](docs, labels.limit(0)).count() == docs.count()
    none = docs.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    assert OPERATORS[name](none, labels).count() == docs.count()


def test_pipeline(spark, tmp_path):
    docs, labels = tables(spark, "long")
    for name, table in (("odd", docs), ("empty", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        held = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = held.columns
            stage(spark, held, str(tmp_path / name)).write.parquet(str(tmp_path / name / str(k)))
            held = spark.read.parquet(str(tmp_path / name / str(k)))
            assert k == 4 or held.columns == columns
        assert held.count() == corpus_pipeline.run(spark, str(tmp_path / name)).count()
        assert (held.count() > 0) == (name == "odd")
        # and each stage on the odd rows themselves
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, str(tmp_path / name))
            assert k == 4 or out.columns == docs.columns
            out.write.format("noop").mode("overwrite").save()

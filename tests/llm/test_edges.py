"""What holds for every operator: ids of any size, nested kept columns, clashing names, very long texts."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm.license_scan import Scanner, license_scan, scan_row
from quarry.llm.mixing import cube_mix, mixed_documents, taken_rows
from quarry.llm.near_copies import drop_near_copies
from quarry.llm.quality_rules import lines_of, metrics, quality_rules
from quarry.llm.secret_scan import base_spans, candidates, secret_scan
from quarry.llm.sentencepiece_codec import MODEL, Codec, load, sentencepiece_encode
from quarry.llm.sharding import reshard
from quarry.llm.simhash import fingerprint, shingles, simhash_components
from quarry.llm.token_counts import TOKENIZER, encoder, ranks_of, token_lengths

IDS = [2**53 + 1, 2**60 + 1, None, 2**60 + 3, -(2**63), 2**63 - 1, 0]
NESTED = "array<bigint>, map<string,bigint>, struct<x:bigint,y:array<string>>".split(", ")


@pytest.fixture(scope="module")
def wide(spark):
    """Large and null ids in one batch, and columns of every kind to be kept."""
    big = 2**62 + 1
    rows = [(i, f"text number {k} " + " ".join(f"w{k}x{j}" for j in range(60)), "en", "s", None if k % 2 else big + k, [big, None, k], {"a": big + k}, (None if k % 3 else big, ["é", None])) for k, i in enumerate(IDS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, many array<bigint>, named map<string,bigint>, both struct<x:bigint,y:array<string>>"
    return spark.createDataFrame(rows, schema).coalesce(1)


KEEPING = {
    "sentencepiece_encode": lambda d, k: sentencepiece_encode(d, keep=k),
    "license_scan": lambda d, k: license_scan(d, keep=k),
    "quality_rules": lambda d, k: quality_rules(d, keep=k, cleaned=True),
    "secret_scan": lambda d, k: secret_scan(d, keep=k, redact="<S>"),
    "token_lengths": lambda d, k: token_lengths(d, keep=k),
    "reshard": lambda d, k: reshard(d, keep=k, old_shard=F.lit(0)),
}


@pytest.mark.parametrize("name", KEEPING)
def test_kept_columns_come_out_as_they_went_in(wide, name):
    cols = tuple(wide.columns)
    out = KEEPING[name](wide, cols)
    assert [out.schema[c].dataType for c in cols] == [wide.schema[c].dataType for c in cols]
    assert Counter(str(tuple(r[c] for c in cols)) for r in out.collect()) == Counter(str(tuple(r)) for r in wide.collect())


def test_ids_of_results(wide):
    assert Counter(r.doc_id for r in simhash_components(wide).collect()) == Counter(IDS)
    found = {r.doc_id: r.component_id for r in simhash_components(wide).collect()}
    assert all(c in IDS for c in found.values())
    mix = cube_mix(wide)
    assert Counter(r.doc_id for r in taken_rows(mix).collect()) == Counter(IDS)
    assert set(r.doc_id for r in mixed_documents(wide, mix).collect()) <= set(IDS)
    assert Counter(str(r) for r in drop_near_copies(wide).collect()) == Counter(str(r) for r in wide.collect())


def test_ids_through_the_pipeline(spark, wide):
    import corpus_pipeline as p
    from quarry.llm.common import save

    docs = wide
    for name, stage in p.STAGES[:-1]:
        out = save(stage(spark, docs, ""))
        rows = {r.doc_id: str(r) for r in docs.collect()}
        got = [(r.doc_id, str(r)) for r in out.collect()]
        assert got and all(rows[i] == r for i, r in got), name
        if name != "mix":
            assert len(got) == len(IDS)
        docs = out
    assert set(r.doc_id for r in p.tokens(spark, docs, "").collect()) <= set(IDS)


RESULTS = {
    "sentencepiece_encode": "n_tokens token_sha256 round_trip ids",
    "license_scan": "n_words n_base labels score notices",
    "quality_rules": "n_words base_failed kept __cleaned host __lines",
    "secret_scan": "n_assign spans owner repo live base __redacted __text",
    "token_lengths": "n_tokens n_tokens_",
    "reshard": "size shard slot old_shard block __row __before",
}


@pytest.mark.parametrize("name", KEEPING)
def test_kept_columns_with_clashing_names(wide, name):
    clash = RESULTS[name].split()
    df = wide.select("doc_id", "text", "lang", "source", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clash))
    out = KEEPING[name](df, ("doc_id", *clash))
    assert len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    plain = KEEPING[name](wide, ("doc_id",))
    own = [c for c in plain.columns if c != "doc_id"]
    unsalted = [c for c in own if c not in ("slot", "shard")]
    assert Counter(str([r[c] for c in ("doc_id", *unsalted)]) for r in rows) == Counter(str([r[c] for c in ("doc_id", *unsalted)]) for r in plain.collect())
    kept = [c for c in out.columns if c not in own and c != "doc_id"]
    assert len(kept) == len(clash)
    for r in rows:
        assert sorted(map(str, (r[c] for c in kept))) == sorted(str(None if r.doc_id is None else f"{c}{r.doc_id}") for c in clash)


def worker(name):
    if name == "sentencepiece":
        codec = Codec(load(open(MODEL, "rb").read()))
        return lambda t: codec.decode(codec.encode([t])[0]) == t
    if name == "license":
        scanner = Scanner()
        return lambda t: scan_row(scanner, t)
    if name == "tokens":
        own = encoder(ranks_of(TOKENIZER))
        return own.encode_ordinary
    return {"secrets": lambda t: candidates(t, base_spans(t)), "quality": lambda t: (metrics(t), lines_of(t)), "simhash": lambda t: fingerprint(shingles(t, 4))}[name]


LONG = {
    "blobs": lambda: "aB3xY9zQ7wE5rT1uI0oP2sD4fG6hJ8k " * 160_000,
    "one letter": lambda: "a" * 3_000_000,
    "notices": lambda: "Released under the MIT License. " * 160_000,
    "lines": lambda: "a b c\n" * 800_000,
    "assignments": lambda: "token = abcdefabcdef0123456789 " * 160_000,
}


@pytest.mark.parametrize("name", ["sentencepiece", "license", "tokens", "secrets", "quality", "simhash"])
def test_very_long_texts(name):
    work = worker(name)
    for what, text in LONG.items():
        began = time.perf_counter()
        work(text())
        assert time.perf_counter() - began < 40, what  # about a second for most; far more if any grew with the square

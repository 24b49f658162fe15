"""Settings, the endpoints over a small index, staged answers, pointers and the evaluation's timings."""

import json
import threading
import urllib.request

import numpy as np
import pytest

from quarry.functions.encode import HashingEncoder
from quarry.plans import engine, evaluate, index
from quarry.service import Invalid, Service, request_of, server, without_nulls
from quarry.settings import Settings, cached_model, from_environment
from test_engine import GROUPED, mapping_rows


def test_settings():
    assert from_environment({}) == Settings()
    s = from_environment({"EMBEDDING_MODEL": "BAAI/bge-m3", "RESULT_LIMIT_DEFAULT": "7", "SOURCE_SCORE_FIELD_WEIGHT": "0.5", "EMBEDDING_NORMALIZE": " Off ", "EMBEDDING_REVISION": " r1 "})
    assert (s.model, s.dimension, s.dtype, s.limit, s.weights.fields, s.normalize, s.revision) == ("BAAI/bge-m3", 1024, "float16", 7, 0.5, False, "r1")
    assert from_environment({"EMBEDDING_MODEL": "own", "EMBEDDING_DIMENSION": "33"}).dimension == 33
    assert s.for_model("intfloat/multilingual-e5-base").dimension == 768 and s.for_model("own").dimension == 1024
    for name, value in (("EMBEDDING_DIMENSION", "0"), ("EMBEDDING_DIMENSION", "many"), ("EMBEDDING_DTYPE", "int8"), ("RESULT_LIMIT_MAX", "3"), ("EMBEDDING_MODEL", "own"), ("DENSE_BATCH_SIZE", "0"), ("SOURCE_SCORE_HYBRID_WEIGHT", "x")):
        with pytest.raises(ValueError, match="dtype|EMBEDDING|RESULT|BATCH|WEIGHT"):
            from_environment({name: value})


def test_cached_models(tmp_path):
    assert cached_model("a/b", root=tmp_path) is None
    home = tmp_path / "models--a--b"
    for r in ("r1", "r2", "r3"):
        (home / "snapshots" / r).mkdir(parents=True)
    assert cached_model("a/b", root=tmp_path) is None
    for r in ("r1", "r2"):
        (home / "snapshots" / r / "config.json").write_text("{}")
    of = lambda **x: getattr(cached_model("a/b", root=tmp_path, **x), "name", None)
    assert of() == "r2" and of(revision="r1") == "r1" and of(revision="r3") == "r2"
    (home / "refs").mkdir()
    (home / "refs" / "main").write_text("r1\n")
    assert of() == "r1" and of(revision="r2") == "r2" and of(revision="gone") == "r1"


def test_requests():
    ask = lambda legacy=False, **x: request_of(json.dumps(x).encode(), Settings(), legacy=legacy)
    assert ask(query="valve") == ("valve", 20, False)
    assert ask(query="valve", limit=3, include_debug=True) == ("valve", 3, True)
    assert ask(True, query="valve", limit=3, top_k=5, use_hybrid=False) == ("valve", 5, False) and ask(True, query="v", limit=3, top_k=None)[1] == 3
    for bad in ({}, {"query": ""}, {"query": 1}, {"query": "x" * 513}, {"query": "x", "limit": 0}, {"query": "x", "limit": 101}, {"query": "x", "limit": True}, {"query": "x", "top_k": 3}, {"query": "x", "other": 1}, {"query": "x", "limit": None}):
        with pytest.raises(ValueError):
            ask(**bad)
    for bad in ({"query": "x", "top_k": 0}, {"query": "x", "top_k": 101}, {"query": "x", "use_hybrid": 1}):
        with pytest.raises(ValueError):
            ask(True, **bad)
    for body in (b"{", b"[]", b""):
        with pytest.raises(Invalid):
            request_of(body, Settings(), legacy=False)
    assert without_nulls({"a": None, "b": [{"c": None, "d": 1}]}) == {"b": [{"d": 1}]}


def roles(dimension):
    """An encoder that tells queries from documents. A class of a function, so that workers get it by value."""

    class Roles(HashingEncoder):
        def encode_query(self, texts):
            return self.encode([f"{t} asked" for t in texts])

        encode_document = encode_query

    return Roles(dimension)


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("served"))
    index.build_index(mapping_rows(spark, GROUPED), root, roles(64), model="roles", smoke=("Temper DN80",), recreate=True)
    return Service(spark, index.open_index(spark, root), roles(64), Settings(model="roles", dimension=64))


def test_endpoints(served):
    http = server(served, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{http.server_address[1]}"

    def call(path, body=None):
        request = urllib.request.Request(at + path, None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert call("/health/live") == (200, {"status": "ok"})
    status, ready = call("/health/ready")
    assert status == 200 and ready["status"] == "ok" and ready["point_count"] == 3 and ready["details"]["index_dimension"] == 64
    status, out = call("/v1/search", {"query": "Temper КШ.П.П.015.40-01 Ду80 Ру16", "limit": 2, "include_debug": True})
    assert status == 200 and out["count"] == len(out["results"]) == 2 and out["results"][0]["rank"] == 1
    assert set(out["timing_ms"]) == {"normalize", "embedding", "retrieval", "ranking", "total"} and out["debug"]["processed_query"]["dn"] == 80.0
    assert out["timing_ms"]["total"] == pytest.approx(sum(v for k, v in out["timing_ms"].items() if k != "total"))
    assert set(out["results"][0]) <= {"rank", "relevance_rating", "product", "match_reasons", "mismatches", "source_evidence", "score_breakdown"} and "url" not in out["results"][0]["product"]
    for path in ("/search", "/analogs"):
        status, old = call(path, {"query": "Temper Ду80", "limit": 3, "top_k": 1})
        assert status == 200 and old["count"] == 1 and "debug" not in old
    assert call("/v1/search", {"query": ""})[0] == 422 and call("/v1/search", {"query": "x", "top_k": 1})[0] == 422
    assert call("/nowhere")[0] == 404 and call("/v1/search")[0] == 404
    http.shutdown()


def test_not_ready(served):
    assert Service(None, None, None).handle("GET", "/health/ready")[0] == 503 and Service(None, None, None).handle("POST", "/search", b"{}")[0] == 503
    other = Service(served.spark, served.idx, roles(32), Settings(model="roles", dimension=32))
    status, out = other.handle("GET", "/health/ready")
    assert status == 503 and out["reason"] == "INDEX_DIMENSION_MISMATCH" and out["details"]["runtime_dimension"] == 32


def test_answer_is_search(served):
    """The staged program gives what the one over many queries gives."""
    spark, query = served.spark, "Broen DN50 PN10 газ"
    one = engine.answer(spark, query, served.idx, served.encoder, served.settings).results
    many = engine.search(spark.createDataFrame([(0, "Temper"), (1, query)], "query_id long, query string"), served.idx, served.encoder, served.settings)
    got = [r.asDict(recursive=True) for r in many.where("query_id = 1").orderBy("rank").collect()]
    assert [(r["id"], r["score"], r["match_reasons"]) for r in one] == [(r["id"], r["score"], r["match_reasons"]) for r in got] and one


def test_pointers_are_never_missing(spark, tmp_path):
    root = str(tmp_path)
    seen, stop = [], threading.Event()
    assert index.active(spark, root) is None and index.publish(spark, root, "v0")

    def read():
        while not stop.is_set():
            seen.append(index.active(spark, root))

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 12):
        assert index.publish(spark, root, f"v{i}") and not index.publish(spark, root, f"v{i}")
    stop.set()
    reader.join()
    assert None not in seen and seen == sorted(seen, key=lambda v: int(v[1:])) and index.active(spark, root) == "v11"
    assert len(index.pointers(spark, root)) == 2


def test_metadata_from_a_report(served):
    meta = index.replace(served.idx.meta, embedding_model=None, embedding_dimension=None)
    got = index.filled(meta, {"embedding_model": "m", "embedding_dimension": 5, "embedding_revision": "other"})
    assert (got.embedding_model, got.embedding_dimension, got.embedding_revision) == ("m", 5, "")
    assert index.filled(meta, None) == meta


def test_a_report_must_fit(spark, monkeypatch):
    """A build report names a version only if it is of this alias and of the model asked for."""
    monkeypatch.setattr(index, "active", lambda spark, root: None)
    opened = []

    def look(spark, root, name):
        opened.append(name)
        raise index.Missing(name)

    monkeypatch.setattr(index, "open_version", look)
    fits = {"collection_name": "v1", "collection_alias": index.POINTER, "embedding_model": "m"}
    for report, model, want in ((fits, "m", ["v1"]), (fits, None, ["v1"]), (fits, "other", []), (fits | {"collection_alias": "x"}, "m", []), ({"collection_name": "v1"}, "m", []), (None, "m", [])):
        opened.clear()
        with pytest.raises(index.Missing):
            index.open_index(spark, "/nowhere/at/all", model=model, report=report)
        assert opened == want


def test_order_of_models():
    of = lambda name, **x: evaluate.Result(name, **x)
    assert evaluate.nearest_rank([5.0, 1.0, 3.0, 2.0], 50) == 2.0 and evaluate.nearest_rank([5.0, 1.0], 95) == 5.0 and evaluate.nearest_rank([], 95) == 0.0
    text = evaluate.markdown([of("a", latency_p95_ms=1.0), of("b", status="failed", error="x")])
    assert "Winner: a" in text and "- b: x" in text


def test_encoders_with_roles(spark):
    from quarry.functions.encode import encode

    df = spark.createDataFrame([(2**60 + 1, "a b"), (None, None)], "doc_id long, text string")
    e = roles(8)
    got = {r.doc_id: r.vector for r in encode(df, e, text="text", role="query").collect()}
    assert set(got) == {2**60 + 1, None} and np.allclose(got[2**60 + 1], e.encode(["a b asked"])[0])


def test_pooled_encoder():
    from quarry.functions.encode import PooledEncoder, mean_pool

    states = np.arange(12, dtype=np.float32).reshape(1, 4, 3)
    assert mean_pool(states, np.array([[1, 1, 0, 0]])).tolist() == [[1.5, 2.5, 3.5]] and not mean_pool(states, np.zeros((1, 4))).any()

    def tokenize(texts, most):
        rows = [[ord(c) for c in t][:most] for t in texts]
        width = max(map(len, rows), default=0) or 1
        return np.array([r + [0] * (width - len(r)) for r in rows]), np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows])

    model = lambda ids, mask: np.stack([ids % 7, ids % 5, np.ones_like(ids)], 2)
    e = PooledEncoder(tokenize, model, 3, max_length=4, query_prefix="q: ")
    one, both = e.encode(["abc"]), e.encode(["abc", "a much longer text", ""])
    assert np.allclose(one[0], both[0]) and np.allclose(np.linalg.norm(both, axis=1), [1, 1, 0]) and e.encode([]).shape == (0, 3)
    assert np.allclose(e.encode_query(["abc"]), e.encode(["q: abc"])) and np.allclose(e.encode_query(["q: abc"]), e.encode(["q: abc"])) and np.allclose(e.encode_document(["abc"]), one)
    assert np.allclose(PooledEncoder(tokenize, model, 3, normalize=False).encode(["ab"]), [[(97 % 7 + 98 % 7) / 2, (97 % 5 + 98 % 5) / 2, 1]])

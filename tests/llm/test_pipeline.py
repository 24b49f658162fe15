"""The pipeline's stages, each against its own input."""

import re
from collections import Counter

import corpus_pipeline as p
from quarry.llm.common import save
from quarry.llm.secret_scan import base_spans


def test_stages(spark, docs, edge):
    assert 4 <= len(p.STAGES) <= 5
    for start in (docs, edge, edge.limit(0)):
        df = start
        for name, stage in p.STAGES:
            out = save(stage(spark, df, "/nowhere"))
            before, after = df.collect(), out.collect()
            if name != "tokens":
                assert out.columns == start.columns, name
            if name == "quality":
                words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
                assert not any(len(words(r.text)) < 40 for r in after)
                clean = Counter()
                for r in before:
                    w = words(r.text)
                    if len(w) >= 60 and len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) == len(w) - 2:
                        clean[r.doc_id] += 1
                assert clean <= Counter(r.doc_id for r in after)
            if name == "near_dedup":
                assert len({r.text for r in after}) == len(after) <= len(before)
            if name == "secrets":
                assert len(after) == len(before) and not any(base_spans(r.text or "") for r in after)
                assert all(r.n_chars == len(r.text) for r in after if r.text and "<SECRET>" in r.text)
            if name == "mix":
                assert set(after) <= set(before) and max(Counter(after).values(), default=0) <= 3 * max(Counter(before).values(), default=1)
            if name == "tokens":
                assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after) and all(len(r.ids) == r.n_tokens and (r.round_trip or name) for r in after)
            df = out


def test_run(spark, sf):
    out = p.run(spark, sf)
    assert out.count() > 50 and out.where("not round_trip").count() == 0

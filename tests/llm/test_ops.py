"""The registered queries, column by column, against the libraries and brute force; secrets on awkward text."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import pytest
from test_dedup import brute_lines, near
from test_texts import BYTES, WORDS, check_packing, library, plain_base

from weirflow.llm import catalogue, lines, secrets
from weirflow.sources import shared


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r for r in docs.collect()}


def rows(spark, sf_dir, name):
    return catalogue.QUERIES[name](spark, sf_dir).collect()


def test_op1(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op1_virtual_slots")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    by, load = defaultdict(list), Counter()
    for r in got:
        data = (texts[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        by[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and by.keys() <= set(range(16))
    assert {r.map_version for r in got} == {2}


def test_op2(spark, sf_dir, texts):
    want = brute_lines([(i, r.text) for i, r in texts.items()], lines.within)
    got = rows(spark, sf_dir, "op2_segment_edit_join")
    assert {r.doc_id: [r.n_lines, r.n_links, r.kept] for r in got if r.n_lines} == want
    assert len(got) == len(texts) and all(r.n_kept == len(r.kept) for r in got)


def test_op3(spark, sf_dir, texts):
    theirs = library(BYTES)
    for r in rows(spark, sf_dir, "op3_forced_boundary_bpe"):
        ids = theirs.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids
        back = theirs.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_op5(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op5_prob_minhash")
    want = near([(i, texts[i].text) for i in sorted(texts)])
    groups = defaultdict(list)
    for i, c in want.items():
        groups[c].append(i)
    assert {r.doc_id: (r.class_id, r.class_size, r.kept) for r in got} == {i: (min(groups[c]), len(groups[c]), i == min(groups[c])) for i, c in want.items()}


def test_op7(spark, sf_dir, texts):
    from test_texts import plain_matches

    for r in rows(spark, sf_dir, "op7_surrogates"):
        before = texts[r.doc_id].text
        assert (r.text == before) == (r.n_entities == 0)
        assert r.n_entities == r.n_email + r.n_ipv4 + r.n_ssn + r.n_phone + r.n_card + r.n_name
        assert r.n_email == sum("@" in m for m in plain_matches(before or ""))


def test_op8(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op8_minimum_bin_slack")
    check_packing(got, [(i, r.text) for i, r in texts.items()])
    assert library(WORDS).get_vocab_size() == 49408


def test_op9(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op9_entropy_secrets")
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id].text or "")
        kinds = Counter(k for _, _, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        said = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("entropy")] == said
        assert spans == [f"{k}:{a}:{b}" for a, b, k in secrets.scan(texts[r.doc_id].text or "")]


def test_op10(spark, sf_dir, texts):
    got = rows(spark, sf_dir, "op10_kneser_ney_language")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    langs = {r.lang for r in texts.values()}
    right = seen = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        letters = any(map(str.isalpha, texts[r.doc_id].text or ""))
        assert r.lang_pred in langs if letters else (r.lang_pred, r.score) == ("und", 0)
        if r.held_out and letters and texts[r.doc_id].lang:
            seen, right = seen + 1, right + (r.lang_pred == texts[r.doc_id].lang)
    assert right >= 0.95 * seen


def test_secrets_take_linear_time():
    rng = random.Random(2)
    for text in ("-".join(["ab"] * 60) + "-9", "ab-" * 20_000 + "9", "aB" * 30_000 + "9", "Aa" * 30_000 + "-9", "-" * 60_000 + "a9", "abcdefgh" * 8_000 + "9"):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            secrets.scan(text)
            took.append(time.perf_counter() - began)
        assert min(took) < 0.01 + len(text) * 5e-5
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for n in (40, 64, 128, 256):
        assert sum(bool(secrets.scan("".join(rng.choices(letters, k=n)))) for _ in range(1000)) >= 990
    assert secrets.scan("q7Zr111PwX9vKd2LmT8sBy4N") and secrets.scan("q7Zr121PwX9vKd2LmT8sBy4N")


def test_pipeline_stages_on_odd_input(spark, sf_dir):
    """Nulls everywhere, an empty and a very long text, repeated rows, missing and clashing columns, no rows."""
    import corpus_pipeline as pipeline

    long = "the house of the river " * 30_000
    odd = [(1, None, 1), (2, "", 1), (3, "12 34", 1), (4, "Los perros de la casa corren por el campo", 1), (4, "Los perros de la casa corren por el campo", 1), (None, "los perros de la casa corren por el campo", None), (7, long, 1), (8, "password=12345678", 1), (None, None, None)]
    known = [(1000 + i, f"the {w} of the river and the {w} that was there {i}", 1) for i, w in enumerate(["house", "dog", "tree", "road", "boat"] * 12)]
    docs = spark.createDataFrame([(i, t, "en" if i and i >= 1000 else None, k) for i, t, k in odd + known], "doc_id long, text string, lang string, rid int")
    for name, step in pipeline.STAGES[:-1]:
        given = docs if name == "language" else docs.where("doc_id < 1000 OR doc_id IS NULL")
        got = step(spark, given, sf_dir)
        assert got.columns == docs.columns
        kept = Counter((r.doc_id, (r.text or "")[:30]) for r in got.collect())
        if name == "language":
            assert not {k for k in kept if k[0] in (1, 2, 3)} and sum(k[0] is not None and k[0] >= 1000 for k in kept) == 60
        if name == "exact":
            assert sum(kept.values()) == 5 and kept[4, "Los perros de la casa corren p"] == 1
        if name == "near":
            assert sum(kept.values()) == 7
        if name == "secrets":
            assert sum(kept.values()) == 9 and (8, "[secret]") in kept
        assert step(spark, given.limit(0), sf_dir).collect() == []
    packed = pipeline.pack(spark, docs, sf_dir).collect()
    assert sum(r.length == 1 and list(r.ids) == [1] for r in packed if r.doc_id in (1, 2)) == 2
    assert sum(r.length for r in packed if r.doc_id == 7) == 150_001
    assert pipeline.pack(spark, docs.limit(0), sf_dir).collect() == []


def test_tables_on_the_way_are_deleted(spark, docs):
    import os

    from weirflow.llm import neardup

    at = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    out = neardup.one_of_each(docs)
    n = out.count()
    names = {x.split("-")[1] for x in set(os.listdir(at)) - before}
    assert names == {"numbered", "gone"} and n > 0
    shared.discard(out)
    assert set(os.listdir(at)) == before

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken

from threadloom.llm.bpe import read_ranks
from threadloom.llm.mixing import Targets, WEIGHTS, budgets


def fixture(n=260):
    rng = random.Random(11)
    kinds = {"en": ["the", "ing", "er", "on"], "de": ["sch", "ein", "ung", "ä"], "fr": ["que", "é", "ion", "le"], "es": ["ción", "os", "ar", "la"]}

    def words(lang, k):
        return ["".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 4))) + str(rng.randint(0, 9)) for _ in range(k)]

    rows, bases = [], [(x, words(x, rng.randint(20, 90))) for x in list(kinds) * 6]
    for i in range(n):
        lang, w = rng.choice(bases)
        w = list(w)
        kind = rng.random()
        if kind < 0.35:
            lang = rng.choice(list(kinds))
            w = words(lang, rng.randint(1, 80))
        elif kind < 0.7:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = words(lang, 1)[0]
        rows.append((i, rng.choice([" ", "\n"]).join(w), lang, f"src{rng.choice([0, 0, 0, *range(20)])}", i))
    return rows + [(n, None, "en", "src1", 0), (n + 1, "", "en", "src1", 0), (n + 2, "12 ?", "de", "src2", 0), (n + 3, rows[4][1] + " ", "en", "src3", 1)]


def brute(rows, seed_targets):
    white = re.compile(r"[\x20\x09-\x0D]+")
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = defaultdict(list)
    for r in rows:
        groups[white.sub("", r[1])].append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    sets = []
    for r in rows:
        w = [x for x in white.split(re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return rows, label


def test_run(spark, tmp_path):
    import corpus_pipeline

    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    unique, label = brute(rows, None)
    by_id = {r[0]: (r, x) for r, x in zip(unique, label, strict=True)}
    assert {r.doc_id for r in got} <= set(by_id)
    # which one of a component stays is free: follow the stages for that choice
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "exact_dedup":
            assert sorted(r.doc_id for r in docs.collect()) == sorted(by_id)
    kept = docs.collect()
    assert sorted(by_id[r.doc_id][1] for r in kept) == sorted(set(label))
    leaves, held = defaultdict(int), defaultdict(list)
    for r in kept:
        leaf = (f"domain{int(r.source[3:]) % 4}", r.lang, r.source)
        k = len(r.text.split())
        leaves[leaf] += k
        h = int(hashlib.md5(f"17|0|{r.doc_id}|{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        held[leaf].append((h, r.doc_id, k, r))
    want = {}
    for leaf, budget in budgets(dict(leaves), Targets(WEIGHTS, share=corpus_pipeline.SHARE)).items():
        total = 0
        for _, doc, k, r in sorted(held[leaf], key=lambda x: x[:2]):
            if total >= budget:
                break
            total += k
            want[doc] = r
    assert sorted(want) == sorted(r.doc_id for r in got)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in got:
        ids = library.encode_ordinary(want[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].text.encode()).hexdigest()


def test_small_frames_start_no_python_workers(spark, monkeypatch):
    """Rows that the driver hands to executors come by Arrow; as lists they would be unpickled in a second pool of workers."""
    from pyspark import SparkContext

    from threadloom.llm.dedup_exact import keep_first
    from threadloom.llm.mixing import mix

    docs = spark.createDataFrame(fixture(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    empty = docs.limit(0)

    def refuse(*args, **kwargs):
        raise AssertionError("a list goes through a pool of Python workers of its own")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    kept = keep_first(docs)
    assert kept.count() > 0 and mix(kept, Targets(WEIGHTS, share=0.8)).count() > 0
    assert keep_first(empty).count() == 0 and mix(empty, Targets(WEIGHTS, share=0.8)).count() == 0


def test_language_id_needs_no_pandas_in_workers(spark):
    from threadloom.llm import langid

    assert "pandas" not in vars(langid) and "pd" not in vars(langid)
    rows = [(i, x, lang, "s", 1) for i, (x, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("", "de"), ("12 ?", "de")] * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert all(got[i][0] == (lang if x and x[0].isalpha() else "und") and 0 <= got[i][1] <= 1 for i, x, lang, *_ in rows)
    assert langid.identify(docs.limit(0)).collect() == []

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquill.llm import surrogates
from sparkquill.llm._stage import staged
from sparkquill.llm._tokens import load_tokenizer, tokenizer_path
from sparkquill.llm.queries import surrogate_key
from sparkquill.llm.quality_trees import quality_scores


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(12)
    def text():
        return ". ".join(" ".join(f"word{k}" for k in rng.integers(0, 3000, 12)) for _ in range(6))

    leak = " ".join(f"bench{k}" for k in range(14))
    good = [(i, text()) for i in range(300)]
    junk = [(1000 + i, "### $$$ " * 40) for i in range(150)]
    copy, leaky, private = (2000, good[7][1] + " tail"), (2001, text() + " " + leak), (2002, text() + " write to someone@example.com")
    rows = [*good, *junk, copy, leaky, private, (2003, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_hit string")
    for name, df in (("documents", docs), ("labels", spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + junk], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, leak)], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    current, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        current = staged(stage(spark, current, str(tmp_path)))
        kept[name] = {r.doc_id: r for r in current.collect()}
        if name != "bpe":
            assert current.columns == docs.columns
    assert not set(kept["quality"]) & set(range(1000, 1150)) and {i for i, _ in good} <= set(kept["quality"])
    assert 2000 not in kept["near_dedup"] and {i for i, _ in good} <= set(kept["near_dedup"])
    assert 2001 not in kept["decontamination"] and {i for i, _ in good} <= set(kept["decontamination"])
    changed = kept["pii"][2002]
    assert "someone@" not in changed.text and re.search(r"\S+@\S+\.com$", changed.text) and changed.n_chars == len(changed.text)
    assert all(kept["pii"][i].text == t for i, t in good)
    assert set(kept["bpe"]) == set(kept["pii"])


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "bpe"]


def _runs(text, split, n):
    words = re.findall(split, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _first_of_components(texts):
    """doc_id -> smallest doc_id of its component; links are similarities of 0.8 or more, compared in whole numbers."""
    sets = {i: _runs(t, "[^\x20\x09-\x0d]+", 5) for i, t in texts.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_run_equals_brute_force(spark, tmp_path):
    """All stages but the first, whose classifier is taken as it is, against plain Python."""
    rng = np.random.default_rng(21)
    def words(n):
        return [f"word{k}" for k in rng.choice(5000, n, replace=False)]

    def changed(base, at):
        return [f"other{w}" if k in at else w for k, w in enumerate(base)]

    leak = " ".join(f"bench{k}" for k in range(14))
    good = [(i, " ".join(words(60 + i % 9))) for i in range(200)]
    junk = [(1000 + i, "### $$$ " * 40) for i in range(100)]
    rows, pairs = [*good, *junk], {}
    for k, (n, at) in enumerate([(54, {25}), (49, {25}), (48, {25}), (60, {30}), (104, {20, 60}), (49, {20, 40}), (200, {100})]):  # one change in n words leaves n - 9 of n + 1 runs
        base = words(n)
        rows += [(2000 + 10 * k, " ".join(base)), (2001 + 10 * k, " ".join(changed(base, at)))]
        pairs[2001 + 10 * k] = 10 * (n - 4 - 5 * len(at)) >= 8 * (n - 4 + 5 * len(at))
    chain = words(54)
    rows += [(2100 + k, " ".join(changed(chain, set(range(10, 10 + k))))) for k in range(6)]
    rows += [(2200, " ".join(words(60)) + " " + leak.upper()), (2201, " ".join(words(60)) + " " + leak[: leak.index("bench9")]), (2202, " ".join([*words(60), "to someone@example.com"])), (2203, " ".join([*words(60), "Someone@Example.com."])), (2204, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + junk], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, leak)], "item_id long, text string"))):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    read = [spark.read.parquet(str(tmp_path / f"{name}.parquet")) for name in ("documents", "labels")]
    left = {r.doc_id: r.text for r in quality_scores(*read, keep=["doc_id", "text"]).filter("predicted = 1").collect()}
    assert set(pairs) | {k - 1 for k in pairs} <= set(left)

    root = _first_of_components(left)
    assert all((root[i] < i) == near for i, near in pairs.items()) and set(pairs.values()) == {True, False}
    left = {i: t for i, t in left.items() if root[i] == i}
    split = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    left = {i: t for i, t in left.items() if not (_runs(t, split, 10) & _runs(leak, split, 10))}
    assert 2200 not in left and 2201 in left
    mail = r"[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"
    mails = spark.createDataFrame([(m,) for m in sorted({m for t in left.values() for m in re.findall(mail, t or "")})], "entity string")
    new = {r.entity: r.new for r in mails.select("entity", surrogates.surrogate(F.col("entity"), F.lit(0), surrogate_key(spark)).alias("new")).collect()}
    left = {i: re.sub(mail, lambda m: new[m[0]], t or "") for i, t in left.items()}
    tokenizer, want = load_tokenizer(tokenizer_path("byte_bpe_50k.json")), {}
    for i, t in left.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want

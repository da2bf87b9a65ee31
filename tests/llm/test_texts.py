"""Quality rules, fingerprints, near-duplicates and classifiers against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, TEXTS, multiset
from triagekit.llm import components, fm, phrases, rules, simhash, structure, toxic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 2000 else len(lines) - len(set(lines)), len(covered),
    )


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab #\n\tÄ\x1c .|")), max_size=80))
def test_counts(text):
    s = structure.structure(text)
    assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == plain_counts(text)


def check_verdicts(docs):
    rows = docs.select("doc_id", "text").collect()
    found = [structure.structure(r.text) for r in rows]
    patterns = Counter(rules.votes_of(s) for s in found if not rules.base_failed(s))
    model = rules.fit_label_model(dict(patterns))
    expected = []
    for r in rows:
        counts = plain_counts(r.text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        good = model.posterior([rules.votes_of(structure.structure(r.text))])[0] >= 0.5
        expected.append((r.doc_id, *counts, failed, bool(good and not failed)))
    got = rules.quality_verdicts(docs).select("doc_id", *rules.COUNTS, "base_failed", "kept").collect()
    assert multiset(got) == multiset(expected)
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert multiset(kept.select("doc_id").collect()) == multiset((e[0],) for e in expected if e[-1])


def test_quality_rules(documents, edge):
    check_verdicts(documents)
    check_verdicts(edge)


def test_quality_rules_empty(none):
    assert rules.quality_verdicts(none).count() == 0 == rules.keep_good(none).count()


SCRIPTS = {
    "hindi": ("यह वह है और में से का की के को पर नदी पहाड़ किताब सुबह शाम बच्चे विद्यालय जाते लिखते पढ़ते गाँव शहर बाज़ार सब्ज़ी दूध पानी लोग काम करते देश", "।", " "),
    "arabic": ("في من على إلى هذا كان البيت الكتاب المدرسة الولد قرأ كتب ذهب صباح مساء السوق الماء الناس عمل مدينة قرية جديد كبير صغير طويل بعد قبل", ".", " "),
    "urdu": ("یہ وہ ہے اور میں سے کا کی کے کو پر دریا پہاڑ کتاب صبح شام بچے اسکول جاتے لکھتے پڑھتے گاؤں شہر بازار دودھ پانی لوگ کام", "۔", " "),
    "chinese": ("我们 今天 早上 学校 老师 学生 读书 写字 城市 乡村 市场 买菜 喝水 工作 回家 山上 河边 朋友 一起 走路 看见 新的 大的 小的", "。\n", ""),
    "thai": ("วันนี้ เช้า โรงเรียน ครู นักเรียน อ่าน หนังสือ เขียน เมือง บ้าน ตลาด ซื้อ ผัก ดื่ม น้ำ ทำงาน กลับ ภูเขา แม่น้ำ เพื่อน", " ", ""),
}


def clean_text(name, sentences=70):
    words, end, blank = SCRIPTS[name]
    rng = np.random.default_rng(5)
    return "".join(blank.join(rng.choice(words.split(), rng.integers(7, 12))) + end + blank for _ in range(sentences))


def test_clean_texts_of_other_scripts_are_kept(spark, documents):
    names = sorted(SCRIPTS)
    texts = [(-1 - i, clean_text(name)) for i, name in enumerate(names)]
    spam = [(-100 - i, (clean_text(name, 2) + "\n") * 60) for i, name in enumerate(names)]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(texts + spam, "doc_id long, text string"))
    kept = {r.doc_id: r.kept for r in rules.quality_verdicts(docs).where("doc_id < 0").collect()}
    assert kept == {k: True for k, _ in texts} | {k: False for k, _ in spam}
    assert {r.doc_id for r in rules.keep_good(docs).where("doc_id < 0").collect()} == {k for k, _ in texts}


def test_words_and_sentences_of_other_scripts():
    s = structure.structure("यह है। ÄÖ é Ünï 北京！ abc.")
    assert (s.n_brief, s.n_ends, s.n_capitals, s.n_spaced) == (6, 3, 3, 7)
    assert structure.structure("北京 天气 abc").n_spaced == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    accuracy, n = np.array([0.95, 0.9, 0.8, 0.7, 0.6]), 20_000
    truth = rng.random(n) < 0.7
    right = rng.random((n, 5)) < accuracy
    votes = np.where(rng.random((n, 5)) < 0.2, "0", np.where(right == truth[:, None], "+", "-"))
    model = rules.fit_label_model(dict(Counter("".join(v) for v in votes)), rules=5)
    assert abs(model.prior - 0.7) < 0.03
    assert np.abs(model.right_on_good - accuracy).max() < 0.05 and np.abs(model.right_on_bad - accuracy).max() < 0.05


def test_clean_documents_are_kept(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = rules.quality_verdicts(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").where(~F.col("base_failed")).collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


# --- phrase fingerprints ----------------------------------------------------------------------------


def plain_parse(text):
    """The same parse of one text, symbol by symbol."""
    mask, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    names, level = [mix((ord(c) + golden) & mask) for c in text], 0
    while names:
        level += 1
        joined = []
        for n in names:
            if joined and joined[-1][0] == n:
                joined[-1][1] += 1
            else:
                joined.append([n, 1])
        names = [mix((n + k * golden) & mask) if k > 1 else n for n, k in joined]
        labels = names
        for _ in range(phrases.TOSSES):
            new = []
            for i, x in enumerate(labels):
                left = labels[i - 1] if i else x ^ 1
                at = ((x ^ left) & -(x ^ left)).bit_length() - 1
                new.append(2 * at + (x >> at & 1))
            labels = new
        starts = [i for i in range(len(names)) if i == 0 or i + 1 < len(names) and labels[i - 1] > labels[i] < labels[i + 1]]
        out = []
        for low, high in zip(starts, [*starts[1:], len(names)]):
            total = sum(mix((n + (k + 1) * golden) & mask) for k, n in enumerate(names[low:high])) & mask
            out.append(mix(total ^ ((high - low) << 8) ^ level))
        names = out
        yield level, names
        if len(names) == 1:
            return


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abcd e")), max_size=60) | st.text(max_size=20, alphabet=st.characters(exclude_categories=["Cs"])), max_size=6))
def test_parse(texts):
    with np.errstate(all="ignore"):
        got = [[] for _ in texts]
        for level, names, owner in phrases.parse(texts):
            for i in set(owner.tolist()):
                got[i].append((level, names[owner == i].tolist()))
    assert got == [list(plain_parse(t)) for t in texts]


def test_equal_substrings_share_their_inside():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    middle = " ".join(words[:1000])
    a, b = " ".join(words[1000:1400]) + middle, "xyz" + middle + " ".join(words[2000:2300])
    levels = list(phrases.parse([middle, a, b]))
    for level, names, owner in levels[:5]:
        own, in_a, in_b = (set(names[owner == i].tolist()) for i in range(3))
        inner = [n for n in names[owner == 0].tolist()[8:-8]]
        assert set(inner) <= in_a & in_b


def test_fingerprints_do_not_depend_on_the_group():
    texts = [t or "" for t in TEXTS]
    together = phrases.fingerprints(texts)
    assert together == [phrases.fingerprints([t])[0] for t in texts]
    assert together[0] == together[1]
    assert len(set(together)) == len(set(texts))


def expected_edits(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 2
        changed = text[: len(text) - cut] + following[:cut]
        own, other, after = phrases.fingerprints([text, changed, following])
        yield (
            key, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, phrases.likeness(own, other),
            phrases.likeness(own, after),
        )


def test_edited_texts(documents, edge, none, conf):
    assert multiset(phrases.compare_with_edited(documents).collect()) == multiset(expected_edits(documents))
    conf("spark.sql.shuffle.partitions", 2)
    assert multiset(phrases.compare_with_edited(edge).collect()) == multiset(expected_edits(edge))
    assert phrases.compare_with_edited(none).count() == 0
    one = edge.where("doc_id = 5")
    assert multiset(phrases.compare_with_edited(one).collect()) == multiset(expected_edits(one))


def test_likeness_tells_edits_from_strangers(documents):
    rows = [r for r in phrases.compare_with_edited(documents).collect() if r.n_chars > 500]
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.97
    assert np.mean([r.near_edited for r in rows]) > 0.2 and np.mean([r.near_next for r in rows]) < 0.1


# --- near-duplicates ---------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius):
    """Smallest id reachable over links of fingerprints, by comparing all pairs."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for key, f in rows:
        if key is not None:
            least[root(f)] = min(key, least.get(root(f), key))
    return [(key, f"{f:016x}", least.get(root(f))) for key, f in rows]


def check_near(docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs)
    got = got.select("doc_id", simhash.hex_digits(F.col("fp")), "component_id")
    expected = plain_components(rows, 2)
    assert multiset(got.collect()) == multiset(expected)
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns
    kept = Counter(r.doc_id for r in one.collect())
    assert kept == Counter({c: 1 for c in {e[2] for e in expected}})


def test_near_duplicates(documents, edge):
    check_near(documents)
    check_near(edge.where("doc_id is not null or text is null"))


def test_near_duplicates_empty(none):
    assert simhash.near_duplicates(none).count() == 0 == simhash.keep_one(none).count()


@pytest.mark.parametrize("tile", [3, 4096])
def test_all_links_within_the_radius(spark, tile):
    """Clusters of fingerprints at 0 to 4 bits, some over the sign bit, in tiles small and large."""
    rng = np.random.default_rng(11)
    prints = []
    for _ in range(60):
        f = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(6):
            prints.append(f)
            for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                f ^= 1 << int(b)
    prints += [0, 3, 1 << 63, (1 << 64) - 1]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(set(prints))]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), 2, tile).collect()
    unsigned = lambda x: x % (1 << 64)
    assert all((unsigned(r.a) ^ unsigned(r.b)).bit_count() <= 2 for r in links)
    found = components.components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.component].add(unsigned(r.node))
    expected = defaultdict(set)
    for f, (_, _, c) in zip(sorted(set(prints)), plain_components(list(enumerate(sorted(set(prints)))), 2)):
        expected[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


# --- classifiers ----------------------------------------------------------------------------------------


def auc(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    ranks = np.argsort(np.argsort(scores)) + 1
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


SF = "/root/testdata/sf0.1"


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    m = fm.Machine(0.3, rng.normal(size=fm.BUCKETS), rng.normal(size=(fm.BUCKETS, fm.RANK)))
    index, value = fm.features("some words and some more words")
    pairs = sum(
        float(m.factors[index[i]] @ m.factors[index[j]]) * value[i] * value[j] for i in range(len(index)) for j in range(i)
    )
    assert np.isclose(m.logit(index, value), 0.3 + value @ m.linear[index] + pairs, rtol=1e-4)


def test_quality_classifier_on_held_out_rows(spark):
    from triagekit.llm.queries import op10_quality_classifier

    rows = op10_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert auc([r.score for r in rows], [r.quality for r in rows]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    from triagekit.llm.queries import op9_toxicity

    rows = op9_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert auc([r.score for r in rows], [r.toxic for r in rows]) > 0.95


def test_many_harmless_sentences_stay_harmless(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    model = toxic.fit_toxicity(documents, labels, fm.crc32_of("doc_id") % 4 != 2)
    clean = [r.text for r in documents.join(labels.where("toxic = 0"), "doc_id").where(fm.crc32_of("doc_id") % 4 == 2).orderBy("doc_id").collect()]
    toxic_one = documents.join(labels.where("toxic = 1"), "doc_id").where(fm.crc32_of("doc_id") % 4 != 2).orderBy(F.length("text")).first().text
    long = ["wooden table stands near window. " * 10_000, "\n".join(clean[:50]), "wooden table stands near window. " * 10_000 + "\n" + toxic_one]
    scores = [r.score for r in toxic.toxicity(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    alone = toxic.document_score(model.sentences(*toxic.bag(toxic_one)[:2]))
    assert scores[0] < 0.02 and scores[1] < 0.3 and scores[2] >= alone - 1e-9


def test_toxicity_scores_are_the_noisy_or(spark, documents):
    """Every score recomputed word by word, without arrays."""
    model = toxic.fit_toxicity(documents, spark.read.parquet(f"{SF}/labels.parquet"), fm.crc32_of("doc_id") % 4 != 2)

    def plain(text):
        scores = []
        for sentence in re.split(r"[.!?\n]", text or ""):
            words = set(re.findall(r"\w+", sentence.lower()))
            buckets = {zlib.crc32(k.encode()) % toxic.BUCKETS for w in words for k in [f"w{w}"] + [f"{n}{w[:n]}" for n in (4, 5) if len(w) > n]}
            if buckets:
                z = model.bias + sum(float(model.weights[b]) for b in buckets)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        if not scores:
            return 0.0
        left = 1 - toxic.MOST_PRIOR * len(scores) / (len(scores) + toxic.HALF_PRIOR)
        for p in [p for p in scores if p >= toxic.FAINT] + [max([p for p in scores if p < toxic.FAINT], default=0.0)]:
            left *= 1 - min(p, 1 - 1e-12)
        return 1 - left

    got = {r.doc_id: r.score for r in toxic.toxicity(documents, model).collect()}
    expected = {r.doc_id: plain(r.text) for r in documents.collect()}
    assert got == pytest.approx(expected, abs=1e-9)


def test_repeats_of_a_sampled_id_are_reduced_first(spark):
    rows = [(i, 1, "good words here") for i in range(5)]
    docs = spark.createDataFrame([(0, f"text {i % 7}") for i in range(3000)] + [(1, "x" * 60_000), (2, None), (3, ""), (None, "y")], "doc_id long, text string")
    sample = spark.createDataFrame([r[:2] for r in rows], "sample_id long, sample_label int")
    schema = "sample_id long, text string"

    def echo(batches):
        for batch in batches:
            yield batch.select(["sample_id", "text"])

    args = (sample, echo, schema, "doc_id", 50_000, F.col("text"))
    got = fm.training_rows(docs, *args)
    assert [r[0] for r in got] == [0, 2, 3] and got[0][1].startswith("text") and got[1][1] is None
    assert got == fm.training_rows(docs.repartition(7), *args)


def test_offending_sentences_are_found(spark):
    rows = [(i, f"All is well here. {'You are a moron today.' if i % 4 == 0 else 'You are a friend today.'} The end.") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxic.fit_toxicity(docs, labels, F.lit(True))
    found = toxic.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i in range(400) if i % 4 == 0}
    assert {r.sentence.strip() for r in found} == {"You are a moron today"}


def test_classifiers_on_edges(spark, edge, none):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (6, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    no_labels = labels.where("false")
    for l in (labels, no_labels):
        machine, model = fm.fit_quality(edge, l, F.lit(True)), toxic.fit_toxicity(edge, l, F.lit(True))
        scored = edge.select(fm.quality_score(edge, machine).alias("s")).collect()
        assert len(scored) == edge.count() and all(0 <= r.s <= 1 for r in scored)
        bags = toxic.toxicity(edge, model).collect()
        assert len(bags) == edge.count() and all(0 <= r.score <= 1 for r in bags)
    assert none.select(fm.quality_score(none, machine)).count() == 0 == toxic.toxicity(none, model).count()


def test_one_sample_row_per_id(spark):
    labels = spark.createDataFrame([(i % 50, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = fm.labelled_sample(labels, "quality", F.col("doc_id") != 7, 20).collect()
    assert len({r.sample_id for r in rows}) == 20 and 7 not in {r.sample_id for r in rows}


def test_very_long_text_is_scored_whole():
    assert plain_fingerprint(LONG) == simhash.fingerprint(LONG) % (1 << 64)
    assert structure.structure(LONG).n_words == len(LONG.split())

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sarstack.llm import _pieces, decontaminate, line_dedup, mixing, near_dedup, quality_model, quality_rules, queries, secret_scan, token_counts, token_files, url_filter
from tests.llm.conftest import prose
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def bag(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


# --- 1 ------------------------------------------------------------------------

URLS = [
    (1, "http://A.example.COM/en/7?x#y"), (2, "https://example.com/en/8"), (3, "x://com/en/"), (4, "no scheme/com/en/"), (5, None), (6, "http://a.example.net/de/88"),
    (7, "http://net/de/"), (8, "http://ample.com.org/es/"), (9, "http://org?/es/"), (10, "http://notexample.com/en/7"), (11, ""), (12, "http:///en/"), (13, "a://b.com/en/x://c.org/es/"), (13, "a://b.com/en/x://c.org/es/"),
]


def brute_url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(LOW)
        path = re.match(r"[^/?#]*(/[^?#]*)?", rest)[1] or ""
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("max_bytes", [url_filter.MAX_BYTES, 8])  # 8: a pass for each part of the rules
def test_url_rules(spark, max_bytes):
    pages = spark.createDataFrame([(*r, "clash") for r in URLS], "page_id bigint, url string, rule string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, url_filter.RULES), max_bytes=max_bytes)
    assert bag(got.select("page_id", "host", "path", "rule", "verdict").collect()) == bag((i, *brute_url(u)) for i, u in URLS)


def test_url_empty_tables(spark):
    pages, rules = spark.createDataFrame([], "page_id bigint, url string"), url_filter.rule_table(spark, [])
    assert url_filter.filter_urls(pages, url_filter.rule_table(spark, url_filter.RULES)).count() == 0
    one = spark.createDataFrame(URLS[:2], "page_id bigint, url string")
    assert {r.verdict for r in url_filter.filter_urls(one, rules).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    n = 20_000
    uni = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    c = url_filter.build_cascade(uni, "listed")
    assert len(c.levels) > 1
    assert uni.where(c.member(F.col("key")) != F.col("listed")).count() == 0


# --- 2 ------------------------------------------------------------------------

def test_classifier_held_out_accuracy_and_blind_to_other_columns(spark):
    got = {r.doc_id: r for r in quality_model.op2_quality_model(spark, "/root/testdata/sf0.01").collect()}
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [x for x in labels if got[x["doc_id"]].held_out]
    assert np.mean([got[x["doc_id"]].predicted == x["quality"] for x in held]) > 0.95


def test_classifier_edges(spark, docs, nothing, rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    trees = quality_model.train(docs, none)
    out = quality_model.classify(docs, trees)
    assert out.count() == len(rows) and {r.score for r in out.select("score").collect()} == {0.5}
    assert quality_model.classify(nothing, trees).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None)], "doc_id bigint, quality int")
    assert quality_model.classify(docs, quality_model.train(docs, one)).agg(F.min("score")).first()[0] > 0.9


def test_trees_traverse_as_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    t = quality_model.fit(x, y, n_trees=20)
    raw = np.full(len(x), t.prior)
    for f, c, leaf in zip(t.feature, t.cut, t.leaf, strict=True):
        for i, row in enumerate(x):
            at = 0
            for _ in range(t.depth):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            raw[i] += leaf[at - (1 << t.depth) + 1]
    assert np.allclose(t.score(x), 1 / (1 + np.exp(-raw)))
    assert ((t.score(x) >= 0.5) == y).mean() > 0.95


# --- 3 ------------------------------------------------------------------------

def brute_classes(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = words((t or "").translate(LOW))
            sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,odd", [(4, 32), (5, 0)])
def test_near_duplicates_match_brute_force(docs, rows, k, odd, monkeypatch):
    monkeypatch.setattr(near_dedup, "ODD", odd)  # 0: every bucket takes the leader's way
    got = near_dedup.near_duplicates(docs, k).collect()
    want = brute_classes(rows, k, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_near_duplicates_large_family(spark):
    import random

    rng = random.Random(3)
    base = prose(rng, 120).split()
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = prose(rng, 1) + str(rng.randrange(50))
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()}
    want = brute_classes(rows, 4, 80)
    assert sum(got[i] != want[i][1] for i in got) <= 2  # the candidate search is probabilistic at the threshold


def test_deduplicate_keeps_one_of_each_and_columns(docs, nothing, rows):
    out = near_dedup.deduplicate(docs, 4)
    want = brute_classes(rows, 4, 80)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {None} | {i for i, (_, c) in want.items() if c == i}
    assert near_dedup.deduplicate(nothing).count() == 0


# --- 4 ------------------------------------------------------------------------

def test_wand_equals_scoring_everything():
    import random

    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 40)) for _ in range(50)]
    ix = decontaminate.Index(list(range(50)), texts)
    every = set(range(ix.n_blocks))
    for threshold in (0.1, 0.3, 0.6):
        for _ in range(30):
            terms = np.unique([rng.randrange(len(ix.vocab)) for _ in range(25)])
            score = np.bincount(ix.item[np.isin(ix.term, terms)], ix.impact[np.isin(ix.term, terms)], 50)
            assert dict(ix.wand(terms, threshold, every)) == pytest.approx({i: s for i, s in enumerate(score) if s >= threshold - 1e-9})


def test_retrieve_finds_every_passage_above_threshold():
    import random

    rng = random.Random(6)
    items = [prose(rng, rng.randint(5, 30)) for _ in range(20)]
    ix = decontaminate.Index(list(range(20)), items)
    texts = [prose(rng, 300) for _ in range(4)] + [prose(rng, 70) + " " + items[3] + " " + prose(rng, 90)]
    all_ = decontaminate.block_of(texts)
    got = {(d, i): s for d, i, s in decontaminate.retrieve(ix, all_, *all_.word_hashes(), 0.5, 64)}
    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        for a in range(0, max(len(w), 1), 64):
            block = decontaminate.block_of([" ".join(w[a : a + 128])])
            terms = np.unique([x for x in ix.terms(block.word_hashes()[0]) if x >= 0])
            hit = np.isin(ix.term, terms)
            for i, v in enumerate(np.bincount(ix.item[hit], ix.impact[hit], 20)):
                if v >= 0.5:
                    want[d, i] = max(want.get((d, i), 0), v)
    assert got == pytest.approx(want) and (4, 3) in got


def test_leaks(spark, docs, nothing, rows):
    items = [(1, "Alpha beta, gamma delta epsilon zeta? Eta theta."), (2, "one two"), (3, None), (4, ""), (None, "kappa lambda mu nu xi omicron."), (6, "Alpha beta, gamma delta epsilon zeta? Eta theta.")]
    texts = ["x " * 200 + "ALPHA beta gamma, delta epsilon zeta eta theta!" + " y" * 300, "alpha beta gamma delta", "see one, two now", "two one", "kappa lambda mu nu xi omicron", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(d, b).collect()}
    assert got == {(0, 1), (0, 6), (2, 2), (4, None)}
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()} == {1, 3, 5, 6}
    assert decontaminate.matches(docs, b.limit(0)).count() == 0 and decontaminate.matches(nothing, b).count() == 0
    assert len(list(decontaminate.item_shards(b, limit=60))) > 1
    near = lambda **kw: sorted((r.doc_id, r.item_id or 0, round(r.score, 9)) for r in decontaminate.matches(d, b, **kw).collect())
    assert near(index_bytes=60) == near()


def plain_leaks(docs, items, least=0.8):
    """(doc_id, item_id) by five-word windows of item, question and answer, in plain Python."""
    norm = lambda t: re.sub(r"[!-/:-@\[-`{-~]", "", (t or "").translate(LOW)).split()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    have = {i: (grams(w), f" {' '.join(w)} ") for i, t in docs for w in [norm(t)]}
    out = set()
    for item, text in items:
        q, a = decontaminate.question_answer(text)
        parts = [norm(text)] + [w for w in map(norm, (q, a)) if len(w) >= 8]
        for doc, (own, flat) in have.items():
            for w in parts:
                if w and (f" {' '.join(w)} " in flat if len(w) <= 5 else len(grams(w) & own) >= least * len(grams(w))):
                    out.add((doc, item))
    return out


def test_leaks_equal_plain_search(spark):
    d = [(x["doc_id"], x["text"]) for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    b = [(x["item_id"], x["text"]) for x in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.op4_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert got == plain_leaks(d, b)


# --- 5, 10 ----------------------------------------------------------------------

def test_pieces_equal_the_library(rows):
    texts = [t or "" for _, t, *_ in rows] + ["  a", "a  b ", "a\n\nb c", "a \nb", "\u00a0a b\u00a0 c", "\u3000 x", "a\x1cb c", "it's 's", "a\r\nb", "<|endoftext|> x<|endoftext|>\ny", "e\u0301 \u0301x", "ΑΣ ΣΑΣ.", "1 22 333", "\u2028 q \u2028"]
    e = _pieces.Encoder("byte_bpe_50k.json", limit=50)
    want = [np.array(x.ids, "<u2").tobytes() for x in e.t.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want and e.encode(texts) == want
    c = _pieces.Counter("word_bpe_49k.json", limit=50)
    assert c.count(texts) == [len(x.ids) for x in c.t.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, docs, nothing, rows):
    got = sorted(token_files.encode_and_read(docs).collect(), key=lambda r: r.start)
    t = _pieces.load("byte_bpe_50k.json")
    want = sorted(((i is not None, i or 0, s or "") for i, s, *_ in rows))
    at = 0
    for r, (has, i, s) in zip(got, want, strict=True):
        ids = np.array([*t.encode(s, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if has else None, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.encode_and_read(nothing).count() == 0


def test_token_lookup_and_small_shards(spark, docs, rows, tmp_path):
    uri = f"file://{tmp_path}/t"
    m = token_files.write_tokens(docs, "byte_bpe_50k.json", uri, partitions=2, shard_bytes=2000, block_bytes=300)
    assert m.count() > 4
    t = _pieces.load("byte_bpe_50k.json")
    by = defaultdict(list)
    for i, s, *_ in rows:
        by[i].append([*t.encode(s or "", add_special_tokens=False).ids, 0])
    for i in (0, 2, 70, None):
        assert sorted(x.tolist() for x in token_files.lookup(m, uri, i)) == sorted(by[i])
    assert token_files.lookup(m, uri, 10**9) == []
    full = token_files.read_tokens(m, uri, payload=True).collect()
    assert bag((r.doc_id, tuple(r.ids)) for r in full) == bag((i, tuple(x)) for i, xs in by.items() for x in xs)


def test_token_counts_and_warm_cache(spark, docs, nothing, rows, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    t = _pieces.load("word_bpe_49k.json")
    want = bag((i, len((s or "").encode()), len(t.encode(s or "", add_special_tokens=False).ids)) for i, s, *_ in rows)
    assert bag(token_counts.count_tokens(docs, "word_bpe_49k.json", cache).collect()) == want
    n = spark.read.parquet(cache).count()
    assert n == len({s or "" for _, s, *_ in rows})
    assert bag(token_counts.count_tokens(docs, "word_bpe_49k.json", cache).collect()) == want
    assert spark.read.parquet(cache).count() == n  # nothing was missing
    other = token_counts.count_tokens(docs.limit(5), "piece_bpe_32k.model", cache)
    assert other.count() == 5 and spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert token_counts.count_tokens(nothing, "word_bpe_49k.json", cache).count() == 0


# --- 6 ------------------------------------------------------------------------

def brute_rules(t):
    t = t or ""
    w = words(t)
    n3 = Counter(zip(w, w[1:], w[2:], strict=False))
    cov = {i + j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n3[x] > 1 for j in range(3)}
    ls = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cov)


def test_ledger_policies_and_ablations(spark, docs, nothing, rows):
    led = quality_rules.ledger(docs)
    got = led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert bag(got) == bag((i, *brute_rules(t)) for i, t, *_ in rows)
    kept = quality_rules.apply_policy(led, "v1")
    n = led.count()
    ab = {r.rule: r for r in quality_rules.ablations(led).collect()}
    for name, _ in quality_rules.RULES:
        without = tuple(r for r, _ in quality_rules.RULES if r != name)
        more = quality_rules.apply_policy(led, without).where("kept").count() - kept.where("kept").count()
        assert ab[name].only_this == more and ab[name].failed <= n
    assert quality_rules.ledger(nothing).count() == 0 and {r.failed for r in quality_rules.ablations(quality_rules.ledger(nothing)).collect()} == {0}


# --- 7 ------------------------------------------------------------------------

def waterfill(sizes, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = set(names), float(sum(sizes.values())), {}
    while left:
        level = total / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > cap * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in left}
            break
        out |= {s: cap * sizes[s] for s in over}
        total -= sum(cap * sizes[s] for s in over)
        left -= over
    return out


def test_mix(spark, docs, nothing, rows):
    got = mixing.copies(docs).collect()
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    want = waterfill(dict(sizes), (1, 2, 3), 3)
    taken, big = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.copies <= 3
        taken[r.source] += r.copies * r.size
        big[r.source] = max(big[r.source], r.size)
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 3 * big[s] for s in sizes)
    assert bag(mixing.copies(docs).collect()) == bag(got)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.copies(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_pareto_inclusion_rates(spark):
    rows = [(i, f"{i} " + "w " * 9, "a" if i < 400 else "b", 4.0 if i % 2 else 1.0) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, merit double")
    seen = Counter()
    for seed in range(12):
        got = mixing.copies(d, weights=(1, 3), priority_col="merit", seed=seed).where("source = 'a'").collect()
        assert sum(r.copies * r.size for r in got) == 2000
        for r in got:
            seen[r.doc_id % 2] += r.copies
            assert r.p == pytest.approx(0.8 if r.doc_id % 2 else 0.2)
    # 12 draws of 200 rows each: about 3 standard deviations of an independent draw
    assert seen[1] / 2400 == pytest.approx(0.8, abs=0.025) and seen[0] / 2400 == pytest.approx(0.2, abs=0.025)


def test_mix_cuts_through_equal_rows(spark):
    rows = [(1, "w " * 10, "a")] * 90 + [(i, "w " * 10, "a") for i in range(2, 12)] + [(i, "w " * 10, "b") for i in range(100, 200)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = mixing.copies(d, weights=(1, 2)).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
    assert abs(taken["a"] - 2000 / 3) <= 5 and abs(taken["b"] - 4000 / 3) <= 5
    assert mixing.mix(d, weights=(1, 2)).count() == sum(r.copies for r in got)


# --- 8 ------------------------------------------------------------------------

KIND = (
    ("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute_secrets(t):
    found = sorted((m.start(), o, m.end(), k) for o, (k, p, ok) in enumerate(KIND) for m in p.finditer(t or "") if ok(m))
    text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return tuple(sum(x[1] == o for x in found) for o in range(3)), hashlib.sha256(text.encode()).hexdigest(), text


def test_secrets(spark, docs, nothing, rows):
    got = secret_scan.scan_secrets(docs).collect()
    assert bag((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == bag((i, *n, h) for i, t, *_ in rows for n, h, _ in [brute_secrets(t)])
    for r in got:
        base = ",".join(x for x in r.spans.split(",") if not x.startswith(("key", "live")))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
    assert any("key:" in r.spans for r in got) and any("live:" in r.spans for r in got)
    assert secret_scan.scan_secrets(nothing).count() == 0


def test_ownership_separates_examples(spark):
    shared, own = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    rows = [(i, f"x {shared} y", f"o{i % 5}", "en") for i in range(20)] + [(50 + i, f"{own}", "o1", "en") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(d).collect()}
    assert all(got[i].n_live == 0 and got[i].n_example == 1 and got[i].max_owners == 5 for i in range(20))
    assert all(got[50 + i].n_live == 1 for i in range(3))
    own_table = {r.n_owners: r.n_repos for r in secret_scan.ownership(secret_scan.find_secrets(d)).collect()}
    assert own_table == {5: 5, 1: 1}


# --- 9 ------------------------------------------------------------------------

def brute_lines(rows, least, min_key):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    df = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_key)
    for i, t, *_ in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (len(key(x)) >= min_key and df[key(x)] >= least)]
        yield i, "\n".join(keep), len(ls), len(ls) - len(keep)


@pytest.mark.parametrize("least,min_key,shard", [(10, 1, 1 << 18), (2, 4, 3), (3, 0, 2)])
def test_line_dedup(docs, rows, least, min_key, shard):
    got = line_dedup.drop_lines(docs, least, min_key, shard_keys=shard, cache_bytes=1).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert bag(got) == bag(brute_lines(rows, least, min_key))


def test_line_dedup_empty(nothing):
    assert line_dedup.drop_lines(nothing).count() == 0


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 1 << 63, (2, 50_000), dtype=np.uint64)
    keys[0, ::3] = keys[0, 0]  # keys that share a half
    counts = np.arange(50_000) + 1
    _, slots = line_dedup.build_mph(keys)
    assert sorted(slots.tolist()) == list(range(50_000))
    raw = line_dedup.Shard.pack(keys, counts)
    s = line_dedup.Shard(raw)
    assert (s.get(keys) == counts).all() and len(raw) < 50_000 * 9
    assert (s.get(rng.integers(0, 1 << 63, (2, 50_000), dtype=np.uint64)) > 0).mean() < 0.001
    big = np.array([1, 1 << 40, 3])
    assert (line_dedup.Shard(line_dedup.Shard.pack(keys[:, :3], big)).get(keys[:, :3]) == big).all()
    assert len(line_dedup.Shard(line_dedup.Shard.pack(keys[:, :0], np.empty(0, np.int64))).get(keys[:, :3])) == 3


def test_map_of_ids_keeps_every_marked_text(spark):
    """Texts of compared classes are found without a shuffle of texts: all of them, and few others."""
    texts = spark.range(20000).selectExpr("id - 10000 AS doc_id", "cast(id AS string) AS text")
    ids = texts.where("doc_id % 10 = 3").select("doc_id")
    want = {r.doc_id for r in ids.collect()}
    got = {r.doc_id for r in near_dedup.marked(texts, ids).collect()}
    assert want <= got and len(got) < len(want) + 3000


def test_nearest_takes_one_row_a_set(spark, docs, monkeypatch):
    seen = []
    write = near_dedup.Scratch.write

    def kept(self, df, name):
        out = write(self, df, name)
        if name == "apart":
            seen.append((out.count(), out.select("id").distinct().count()))
        return out

    monkeypatch.setattr(near_dedup.Scratch, "write", kept)
    near_dedup.near_duplicates(docs, 4).collect()
    assert seen and seen[0][0] > 0 and all(n == ids for n, ids in seen)


def test_few_edges_take_no_rounds(spark, docs, monkeypatch):
    names = []
    write = near_dedup.Scratch.write
    monkeypatch.setattr(near_dedup.Scratch, "write", lambda self, df, name: names.append(name) or write(self, df, name))
    near_dedup.near_duplicates(docs, 4).collect()
    assert "labels" in names and "hooks" not in names


@pytest.mark.parametrize("few", [0, 40, 1 << 18])
def test_components_on_the_driver_equal_the_rounds(spark, few, monkeypatch):
    import random

    monkeypatch.setattr(near_dedup, "FEW_EDGES", few)  # 0: rounds only; 40: rounds, then the driver
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    top = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in range(len(top)):
        for x, y in edges:
            if x != y:
                top[x] = top[y] = min(top[x], top[y])
    got = near_dedup.components(near_dedup.Scratch(spark), spark.createDataFrame(edges, "x bigint, y bigint"))
    assert {r.id: r.label for r in got.collect()} == top


def test_few_sets_apart_cost_no_further_plans(spark, docs, monkeypatch):
    """Every plan costs the driver memory: rounds that what follows makes needless are left out, and classes stay the same."""
    names = []
    write = near_dedup.Scratch.write
    monkeypatch.setattr(near_dedup.Scratch, "write", lambda self, df, name: names.append(name) or write(self, df, name))
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_shingles)
    got = sorted(near_dedup.near_duplicates(docs, 4).collect(), key=key)
    assert "nearest" not in names and names.count("labels") <= 3 and names.count("candidates") == 1
    monkeypatch.setattr(near_dedup, "FEW_APART", 0)
    names.clear()
    assert got == sorted(near_dedup.near_duplicates(docs, 4).collect(), key=key) and "nearest" in names


def test_mix_plans_its_counts_once(spark, docs):
    """Texts are joined with written counts: the counts' own plan is not repeated for even and uneven rows."""
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("Join") == 2

"""Every operator against brute force, on a small fixture with nulls, empties, ties, repeats and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, html_extract, line_dedup, near_dedup, packing, pii, quality_rules, secret_scan, sharding, toxicity

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = {c: c + 32 for c in range(65, 91)}
PROSE = "The quick brown fox jumps over the lazy dog. It was seen by many people on that day, and they told of it."
LONG = " ".join(f"word{i % 900} of{i % 7}." for i in range(12_000))
SHARED = "This line stands in several documents."
TEXTS = [
    (1, PROSE), (2, PROSE), (3, PROSE + " Once more."), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"),
    (8, f"{SHARED}\n{PROSE}\n  this LINE stands in several documents.\t\nÉté\n"), (9, f"{SHARED}\r\nshort\nshort\nshort"),
    (10, "a | b | c | d | e | f | g | h | i | j | k | l"), (11, LONG), (12, LONG + " end"), (13, "x " * 300),
    (14, "WOW!! BUY!! NOW!! " * 8), (15, "mail a.b@c.de.fg or x@y, ip 1.2.3.4.5 300.1.1.1, card 4111 1111 1111 1111, call +1 (234) 567-8901 é"),
    (16, 'é token = "0123456789abcdef0123" AKIAABCDEFGHIJKLMN password: token: abcdefghijkl API_KEY=abc'),
    (17, PROSE.upper()), (None, PROSE), (7, "one two"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "kept?", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, kept string, n_words int")


def words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def by_text(df, *columns):
    """Result rows as a multiset; ids may be null."""
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- 1 ---------------------------------------------------------------------------------------------------


def quality_base(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality_base(docs):
    out = quality_rules.apply_quality_rules(docs)
    got = by_text(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == Counter((i, *quality_base(t)) for i, t in TEXTS)


def test_quality_verdict(docs, empty):
    out = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(docs).collect()}
    assert out[1]["kept"] and out[8]["kept"] and not out[10]["kept"] and not out[14]["kept"] and not out[4]["kept"]
    assert out[10]["clean_text"] == "" and out[1]["clean_text"] == PROSE and out[4]["clean_text"] == ""
    assert quality_rules.apply_quality_rules(empty).collect() == []


# ---- 2 ---------------------------------------------------------------------------------------------------


def marked_words(text, items):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for name, item in items:
        v = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (item or "").translate(LOWER))
        for k in range(max(1, len(v) - 12) if v else 0):
            window = v[k : k + 13]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_decontamination(spark, docs, empty, block_words):
    items = [(1, PROSE[:80]), (2, "one TWO"), (10, " ".join(f"word{i % 900} of{i % 7}" for i in range(880, 910))), (3, None), (4, "...")]
    table = spark.createDataFrame(items, "item_id int, text string")
    out = decontaminate.find_benchmark(docs, table, block_words=block_words)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out.collect())
    assert got == Counter((i, n, h, tuple(f)) for i, t in TEXTS for n, h, f in [marked_words(t, items)])
    spans = {r["doc_id"]: r for r in out.withColumn("cut", decontaminate.remove_spans(F.col("text"), F.col("spans"))).collect()}
    assert spans[7]["cut"] == "" and spans[5]["cut"] == "" and spans[1]["cut"].endswith("they told of it.")
    assert decontaminate.find_benchmark(empty, table).collect() == []
    none = decontaminate.find_benchmark(docs, table.where("false"))
    assert none.agg(F.sum("n_hit")).first()[0] == 0


def test_fm_index_against_scan():
    import numpy as np

    rng = np.random.default_rng(3)
    sequence = rng.integers(0, 4, 500)
    index = decontaminate.FMIndex(sequence)
    patterns = [p for p in (sequence[a : a + n] for a in range(0, 400, 37) for n in (1, 3, 6)) if (p > 0).all()]
    padded, lengths = np.zeros((len(patterns), 6), dtype=int), np.array([len(p) for p in patterns])
    for i, p in enumerate(patterns):
        padded[i, : len(p)] = p
    which, low, high = index.search(padded, lengths)
    found = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, low, high, strict=True)}
    for i, p in enumerate(patterns):
        assert found.get(i, []) == [k for k in range(501 - len(p)) if (sequence[k : k + len(p)] == p).all()]


# ---- 3 ---------------------------------------------------------------------------------------------------


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack_documents(docs, with_ids=True).collect()
    expected = Counter()
    for i, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        lo = k = 0
        while lo < len(ids):
            hi = lo + ((len(ids) - lo) % 1024 or 1024)
            part = ids[lo:hi]
            expected[i, k, lo, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), tuple(part)] += 1
            lo, k = hi, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in out) == expected
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(empty).collect() == []


def test_packing_plan():
    counts = {1000: 5, 24: 3, 12: 4, 8: 6, 500: 7, 262: 4, 300: 9, 1023: 2, 1: 1, 1024: 3}
    plan = packing.plan_packing(counts)
    used = Counter()
    for n, lengths in plan:
        assert n > 0 and sum(lengths) <= 1024
        for x in lengths:
            used[x] += n
    assert used == Counter(counts)
    assert (3, [1000, 24]) in plan and (1, [1023, 1]) in plan


# ---- 4 ---------------------------------------------------------------------------------------------------


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in TEXTS:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    first = {k: min((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) > 1}
    expected = Counter()
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in first and first[key(x)] != i)]
        expected[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert by_text(out, "doc_id", "n_lines", "n_dropped", "kept_text") == expected
    assert line_dedup.dedup_lines(empty).collect() == []
    three = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs, min_docs=4).collect()}
    assert three[2] == 1 and three[9] == 0


# ---- 5 ---------------------------------------------------------------------------------------------------


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(sets, percent=85):
    ids = list(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_dedup(docs, empty):
    out = near_dedup.near_duplicates(docs).collect()
    sets = {i: shingles(t) for i, t in TEXTS if i is not None}
    expected = components(sets)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), expected[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"])
    assert len(out) == len(TEXTS)
    assert near_dedup.near_duplicates(empty).collect() == []


def test_near_dedup_chain(spark):
    """Copies that drift: neighbours are linked, the ends are not, and heads of buckets link few."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(24):
        for j in range(k):
            base[(j * 7) % 200] = f"v{j}"
        texts.append((100 - k, " ".join(base)))
    sets = {i: shingles(t) for i, t in texts}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == components(sets)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (55, 60), (70, 70)]
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 55: 50, 60: 50}


# ---- 6 and 9 ---------------------------------------------------------------------------------------------


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def base_pii(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m[0])]


def test_pii(docs, empty):
    base = set(pii.BASE_KINDS)
    got = Counter((r["doc_id"], tuple(tuple(s) for s in r["pii"] if s["kind"] in base)) for r in pii.find_pii(docs).collect())
    assert got == Counter((i, tuple(base_pii(t))) for i, t in TEXTS)
    assert pii.find_pii(empty).collect() == []


def test_pii_added_kinds(spark):
    text = "see https://a.b/c?d, IBAN: GB82 WEST 1234 5698 7654 32, SSN 123-45-6789; jane (at) host (dot) org account no. 12345678"
    row = pii.find_pii(spark.createDataFrame([(text,)], "text string")).withColumn("safe", pii.redact(F.col("text"), F.col("pii"))).first()
    assert {s["kind"]: text[s["start"] : s["end"]] for s in row["pii"] if s["kind"] not in pii.BASE_KINDS} == {
        "url": "https://a.b/c?d", "iban": "GB82 WEST 1234 5698 7654 32", "ssn": "123-45-6789", "email_words": "jane (at) host (dot) org", "account": "12345678"}
    assert "WEST" not in row["safe"] and "<url>" in row["safe"]


def base_secrets(text):
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    return sorted((m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m))


def test_secrets(docs, empty):
    report, ledger = secret_scan.scan_versions(docs)
    got = Counter((r["doc_id"], tuple((s["start"], s["kind_order"], s["kind"], s["end"]) for s in r["findings"] if s["kind_order"] < 3)) for r in report.collect())
    assert got == Counter((i, tuple(base_secrets(t))) for i, t in TEXTS)
    assert ledger.count() == len({hashlib.sha256((t or "").encode()).hexdigest() for _, t in TEXTS})
    assert secret_scan.scan_versions(empty)[0].collect() == []


def test_secret_ledger_scans_only_new(spark, docs):
    _, ledger = secret_scan.scan_versions(docs)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(99, "-----BEGIN RSA PRIVATE KEY-----")], "doc_id long, text string"))
    assert secret_scan.scan_new(more, ledger).count() == 1
    assert secret_scan.scan_new(more, ledger, rule_version="2").count() == ledger.count() + 1
    report, _ = secret_scan.scan_versions(more, ledger)
    assert [s["kind"] for s in report.where("doc_id = 99").first()["findings"]] == ["pem"]
    assert len(report.where("doc_id = 16").first()["findings"]) == len(base_secrets(dict(TEXTS)[16]))


# ---- 7, 8, 10 --------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(toxicity.sample_labelled(docs, labels))
    held = docs.join(labels.where(toxicity.held_out()), "doc_id")
    rows = toxicity.score_toxicity(held, model).select("toxic", (F.col("score") >= 0.3).alias("p")).collect()
    hits = Counter((r["toxic"], r["p"]) for r in rows)
    assert hits[1, True] / (hits[1, True] + hits[1, False]) > 0.9
    assert hits[0, True] / (hits[0, True] + hits[0, False]) < 0.02


def test_toxicity_edges(spark, docs, empty):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.sample_labelled(docs, nothing))
    assert all(0 <= r["score"] < 0.3 for r in toxicity.score_toxicity(docs, model).collect())
    assert toxicity.score_toxicity(empty, model).collect() == []
    finder = toxicity.Finder(["badword" + toxicity.END, "nastiest"], [5.0, 5.0])
    assert [h[:3] for h in finder.hits('a badword, a badwrd and "badword" nastiestly b4dword')[0]] == [(0, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0), (0, 1, 0)]


def test_levenshtein_automaton():
    import itertools

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for word in ("abca", "aab"):
        automaton = toxicity.LevenshteinAutomaton(word, 1)
        for n in range(6):
            for other in map("".join, itertools.product("abc", repeat=n)):
                state = automaton.start
                for c in other:
                    state = automaton.step(state, c)
                d = distance(word, other)
                assert automaton.distance(state) == (d if d <= 1 else None), (word, other)


@pytest.mark.parametrize("limit", [40, 300, 10**9])
def test_sharding(docs, empty, limit):
    out = sharding.assign_shards(docs, max_bytes=limit).collect()
    assert len(out) == len(TEXTS)
    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["n_bytes"])
        assert len(r["shard"]) == r["depth"]
    for r in out:
        assert (r["shard_bytes"], r["shard_rows"]) == (sum(shards[r["shard"]]), len(shards[r["shard"]]))
        assert r["shard_bytes"] <= limit or r["shard_rows"] == 1
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # no shard inside another
    assert sharding.assign_shards(empty).collect() == []


def test_sharding_one_key(spark):
    same = spark.createDataFrame([(1, f"text {i % 3}") for i in range(60)], "doc_id long, text string")
    out = sharding.assign_shards(same, max_bytes=30).collect()
    assert len(out) == 60 and all(r["shard_bytes"] <= 30 for r in out)


def test_html(spark):
    page = (
        "<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav>"
        "<article><h1>A &amp; B</h1><p>One<br>two &lt;3 <b>bold</b></p><div class='ad'>buy</div><p>three</p></article>"
        "<div class=comments><p>first!</p></div><footer>&copy;</footer>"
    )
    rows = [(1, "u", page, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", "just words", "x"), (1, "u", page, "x")]
    out = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id int, url string, html string, text string"))
    want = {1: "A & B One two <3 bold three", 2: "", 3: "", 4: "just words"}
    assert [(r["text"], r["n_chars"]) for r in out.collect()] == [(want[r[0]], len(want[r[0]])) for r in rows]
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []


def test_html_without_article():
    page = "<div id=menu><a>Home</a></div><div><h2>Title</h2><p>" + "Some text here. " * 9 + "</p><p>End.</p></div><ul><li><a>more</a></li><li><a>links</a></li><li><a>here</a></li></ul>"
    assert html_extract.main_text(page) == "Title " + ("Some text here. " * 9).strip() + " End."


def test_html_outside_the_largest_article():
    long, menu = "Some text here. " * 9, "<ul><li><a>more</a></li><li><a>links</a></li><li><a>here</a></li></ul>"
    text = long.strip()
    # the windows decide outside the mark: a surge stays, a short line and a menu don't
    page = f"<div>Site</div><article><p>{long}</p></article><div>Imprint</div>{menu}<p>{long}</p><p>Yes.</p><p>{long}</p>"
    assert html_extract.main_text(page) == f"{text} {text} Yes. {text}"
    assert html_extract.main_text(f"<article><p>{long * 3}</p></article>{menu}<article><p>Short one.</p></article>") == f"{(long * 3).strip()} Short one."
    assert html_extract.main_text(f"<main><h1>Title</h1><article><p>{long}</p></article>{menu}<p>End.</p></main>") == f"Title {text} End."

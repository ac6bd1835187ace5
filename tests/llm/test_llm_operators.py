"""The training-data operators against brute force, libraries, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from alphaloom.llm import classifier, html, media, ngram_join, packing, pieces, pii, quality_rules, suffix_dedup, url_filters

EDGE = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda. " * 3), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "no id here at all"), (6, "word " * 9000), (7, "日本語 \U0001f642 é\n\n\tü"), (8, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda. " * 3), (9, " \n ")]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en", None if i == 3 else "s", 0, "x", "y", 1) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, label string, found int")


def texts(n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "in", "on", "é", "ß", "a", "be", "X"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    for k in range(0, n - 8, 8):
        out[k + 1] = out[k]
        t = out[k].split(" ")
        if len(t) > 60:
            t[len(t) // 2] = "changed"
        out[k + 2] = " ".join(t)
        out[k + 3] = out[k + 3] + " " + out[k][20:200]
    return out


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    for h in (1, 2, 33, 70):
        img = rng.integers(0, 256, (h, 64), dtype=np.uint8)
        assert (media.decode_png(media.encode_png(img)) == img).all()
    # all five filters, undone against a plain implementation
    h, w = 12, 9
    raw = rng.integers(0, 256, (h, w + 1), dtype=np.uint8)
    raw[:, 0] = np.arange(h) % 5
    want = np.zeros((h + 1, w + 1), int)
    for y in range(h):
        for x in range(w):
            a, b, c = want[y + 1, x], want[y, x + 1], want[y, x]
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            want[y + 1, x + 1] = (int(raw[y, x + 1]) + [0, a, b, (a + b) // 2, paeth][raw[y, 0]]) % 256
    assert (media.unfilter(raw) == want[1:, 1:]).all()


def test_png_checksums():
    data = bytearray(media.encode_png(np.zeros((2, 64), np.uint8)))
    for at in (0, 20, len(data) - 2):
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(bytes(data[:-5]))


def test_media_edge_cases(edge):
    got = {(r.id, r.n_bytes): r for r in media.media_features(media.encode_media(edge)).collect()}
    for i, t in EDGE:
        data = (t or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[i, len(data)]
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])


def test_pieces_equal_the_library():
    import sentencepiece

    path = pieces.default_model()
    m, sp = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    alphabet = "abcdehinorst ▁\n0129-.,(éß日я🙂"
    cases = ["", " ", "   x", "a  b", "▁▁", "<s>", "#### ### ##", "    hello" + " " * 40, *texts(60), *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500))]
    for t in cases:
        ids = np.frombuffer(m.encode(t), "<u4").tolist()
        assert ids == sp.encode(t), t
        assert m.decode([1, *ids, 2]) == sp.decode([1, *ids, 2])


def test_pieces_edge_cases(edge):
    rows = pieces.piece_digests(edge, pieces.default_model()).collect()
    assert len(rows) == len(EDGE) and {r.n_tokens for r in rows if r.id in (2, 3)} == {2}


def brute_removed(docs):
    seen, out = set(), {}
    for i, data in sorted(docs):
        gone = bytearray(len(data))
        own = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        out[i] = bytes(b for b, g in zip(data, gone) if not g), sum(gone)
    return out


def test_suffix_dedup_against_brute_force(spark):
    t = texts()
    t[5], t[6], t[7] = "ab" * 200, "x" + "ab" * 150, "the same " * 40
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(5)
    want = brute_removed([(i, x.encode()) for i, x in enumerate(t)])
    for r in suffix_dedup.remove_repeats(df, keep_text=False).collect():
        assert (r.kept, r.n_removed) == (hashlib.sha256(want[r.id][0]).hexdigest(), want[r.id][1]), r.id


def test_suffix_dedup_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 3)
    shared = "this passage stands in each and every document of the lot, word for word, and then some more"
    t = [f"{k * 7919} {k} {shared} {k * k}" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(4)
    want = brute_removed([(i, x.encode()) for i, x in enumerate(t)])
    got = {r.id: r for r in suffix_dedup.remove_repeats(df, keep_text=False).collect()}
    assert all((got[i].kept, got[i].n_removed) == (hashlib.sha256(w).hexdigest(), n) for i, (w, n) in want.items())


def test_suffix_sort_and_collisions(monkeypatch):
    text = b"banana bandana banana bandana cabana"
    s = suffix_dedup.Suffixes(text, 8)
    at = np.arange(len(text) - 8)
    got = [text[a : a + 8] for a in at[s.sort(at, np.zeros(len(at), int))]]
    assert got == sorted(text[a : a + 8] for a in at)
    segments = [b"a" * 60 + b"b", b"a" * 55, b"c" * 50]
    owner, group = np.array([2, 1, 3]), np.array([0, 0, 0])
    want = [x.tolist() for x in suffix_dedup.repeated_windows(segments, owner, group)]
    assert want == [list(range(11)), [], []]
    monkeypatch.setattr(suffix_dedup.Suffixes, "equal_neighbours", lambda self, at: (_ for _ in ()).throw(ValueError("hash collision")))
    assert [x.tolist() for x in suffix_dedup.repeated_windows(segments, owner, group)] == want


def test_suffix_dedup_edge_cases(edge, spark):
    rows = {(r.id, r.n_bytes): r for r in suffix_dedup.remove_repeats(edge).collect()}
    assert rows[8, len(EDGE[0][1])].kept == "" and rows[2, 0].n_removed == 0
    assert suffix_dedup.remove_repeats(edge.limit(0)).count() == 0


def test_main_text():
    page = ("<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='cookie-notice'>ok?</div><article><h1>A &amp; B</h1><p>one\n two<p><b>three<br><p>four"
            "<div class=share>no</div><script>var p='</p>'</script><section id=comments><p>nice</p></section></article><footer>f</footer></body></html>")
    assert html.main_text(page) == "A & B\none two\nthree\nfour"
    for bad in ("", "<", "<p", "<!-- x", "<script>x", "<div>" * 3000 + "deep"):
        html.main_text(bad)
    assert html.main_text("<div>" * 3000 + "deep") == "deep"


def test_wrappers_align():
    w = html.wrapper_of("<body><h1>x</h1><ul><li>a<li>b</ul><p>foot</p></body>")
    for title in ("y", "z"):
        w = html.merge(w, html.wrapper_of(f"<body><h1>{title}</h1><p>foot</p></body>"))
    e = html.expression(w)
    assert "(<li>TEXT)+" in e and "<ul>" in e and ")?" in e and '"foot"' in e and "<h1>TEXT" in e


def test_pages_edge_cases(spark):
    df = spark.createDataFrame([(1, None, None, 1), (2, "http://h/x", "<p>a", 2), (2, "http://h/x", "<p>a", 2), (3, "nohost", "", 3)], "page_id long, url string, html string, text int")
    got = sorted((r.id, r.text) for r in html.extract(df, html.infer_wrappers(df)).collect())
    assert got == [(1, ""), (2, "a"), (2, "a"), (3, "")]


def test_closest_fill_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 7))}
        room = rng.randint(0, 90)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        fill = packing.closest_fill(counts, room)
        assert sum(k * n for k, n in fill.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in fill.items())


def test_packing(spark, edge):
    got = packing.pack_documents(edge).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    t = packing.tokeniser(packing.default_tokeniser())
    for i, text in EDGE:
        n = len(t.own.encode(text or "", add_special_tokens=False).ids) + 1
        assert any(r.doc_id == i and r.doc_tokens == n for r in got)
    for x in ("a <|endoftext|> b", " " * 300, "it's  we'll\n\n x", *texts(40)):
        assert t.ids(x).tolist() == t.own.encode(x, add_special_tokens=False).ids


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_join_against_brute_force(spark):
    t = [*texts(240, 5), "One two three", "one TWO three", "a b", "A b", "z", "", "   "]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(df).collect()}
    assert got == brute_components(list(enumerate(t)))


def far_heads(groups=12, words=100, seed=9):
    """Groups of texts whose smallest id is further off than the limit from all others, which link among themselves; changes at the ends only touch few shingles, some of them rare."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words)]
        head = list(base)
        for k in range(10, 90, 16):
            head[k] = f"far{g}x{k}"
        out.append(" ".join(head))
        for c in range(4):
            copy = list(base)
            copy[-1] = f"end{g}y{c}" if c % 2 else "common"
            copy[0] = f"start{g}y{c}" if c > 1 else "usual"
            out.append(" ".join(copy))
    return out


def test_jaccard_join_counts_all_shared_prefix_shingles(spark):
    for width, percent in ((3, 90), (5, 80)):
        t = [*far_heads(), *texts(120, 6)]
        df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
        got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(df, width, percent).collect()}
        sets = [set(zip(*[re.findall(r"[^ \t-\r]+", x.lower())[k:] for k in range(width)])) or {x.lower()} for x in t]
        assert all(got[k][1] == got[5 * (k // 5) + 1][1] != got[5 * (k // 5)][1] for k in range(60) if k % 5)
        for i in range(len(t)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                assert got[i][1] == got[j][1] or 100 * both < percent * (len(sets[i]) + len(sets[j]) - both) or not t[i].strip()


def test_jaccard_edge_cases(edge):
    rows = ngram_join.near_components(edge).collect()
    assert len(rows) == len(EDGE)
    assert {r.component_id for r in rows if r.id in (1, 8)} == {1} and {r.component_id for r in rows if r.id == 4} == {4}


def test_t_occurrence():
    rng = np.random.default_rng(3)
    for _ in range(80):
        q = np.unique(rng.integers(0, 60, 30)).astype(np.uint64)
        c = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(6)]
        need = [int(rng.integers(1, 20)) for _ in c]
        assert ngram_join.t_occurrence(q, c, need) == [len(np.intersect1d(q, x)) >= n for x, n in zip(c, need)]


def test_pseudonyms(spark):
    rows = ["card 4012 8888 8888 1881 and 4012888888881881 but 4012888888881882", "ip 10.0.0.1. 256.1.1.1", "on 1984-02-29, 31.12.1999, 02/30/2001", "ssn 123-45-6789 000-12-3456", "+1 (766) 555-2373", "a.b@mail.example.com", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', None, ""]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(rows)], "doc_id long, text string, rest int")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    card, again, kept = re.search(r"card ([0-9 ]+) and (\d+) but (\d+)", got[0]).groups()
    assert card.replace(" ", "") == again != "4012888888881881" and kept == "4012888888881882" and card[4] == " "
    digits = [int(x) for x in again][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
    assert "256.1.1.1" in got[1] and "10.0.0.1" not in got[1] and "02/30/2001" in got[2] and "000-12-3456" in got[3]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[4]) and got[4] != rows[4]
    assert "mail.example.com" not in got[5] and "04dbebab" not in got[6] and len(got[6]) == len(rows[6])
    assert got[7] is None and got[8] == ""


def test_pseudonyms_beside_other_numbers(spark):
    card = "4111111111111111"
    rows = ["+1 (826) 555-4081 190.137.223.204", "+1 (843) 555-7672 2024-01-05", "+1 (843) 555-7672 123-45-6789", "+1 (843) 555-7672 4111 1111 1111 1111",
            f"{card} 123", f"12 {card}", f"12345 {card}", f"1 4111 1111 1111 1111 5500 0000 0000 0004 77", f"{card} 2024-01-05", f"{card} 190.137.223.204", f"{card} 9@mail.example.com",
            "1 2 3 4 5 6 7 8 9 10 11 12", "12345678901234567890123", "9 " * 500 + card, "+1 (826) 555-4081 x", f"{card} 12-"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k", found_col="found").collect()}
    kinds = lambda k: [x.kind for x in got[k].found if x.new is not None]
    assert [kinds(k) for k in range(16)] == [
        ["phone", "ipv4"], ["phone", "date"], ["phone", "ssn"], ["phone", "card"], ["card"], ["card"], ["card"], ["card", "card"],
        ["card", "date"], ["card", "ipv4"], ["card", "email"], [], [], ["card"], ["phone"], ["card"]]
    assert not any(v in r.text for r in got.values() for v in ("555-4081", "555-7672", "190.137", "2024-01-05", "123-45-6789", card, "4111 1111", "5500 0000", "mail.example"))
    assert got[4].text.endswith(" 123") and got[6].text.startswith("12345 ") and re.fullmatch(r"1( \d{4}){8} 77", got[7].text) and got[15].text.endswith(" 12-")
    assert got[11].text == rows[11] and got[12].text == rows[12] and got[13].text[:1000] == "9 " * 500


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    d = spark.range(13 * 7).select(pii.feistel(F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(13).cast("long"), F.lit(7).cast("long"), "k", "t").alias("p"))
    assert d.distinct().count() == 13 * 7 and d.where("p.l < 0 or p.l >= 13 or p.r < 0 or p.r >= 7").count() == 0


def test_quality_rules_edges(edge, spark):
    got = {(r.id, r.n_words): r for r in quality_rules.quality_rules(edge).collect()}
    assert got[2, 0].base_failed and not got[2, 0].kept and got[6, 9000].n_repeat_words == 9000
    rows = [(k, f"unique {chr(97 + k % 26) * (k + 1)} words here to keep this document full enough of text\nthe common footer line", "h") for k in range(60)] + [(99, "the common footer line", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r = {x.id: x for x in quality_rules.quality_rules(df).where("id >= 0").collect()}
    assert r[5].n_lines_removed == 1 and r[5].kept and not r[99].kept
    left = {x.doc_id: x.text for x in quality_rules.without_boilerplate(df).collect()}
    assert left[5].endswith("of text") and left[99] == ""


def test_quality_rules_and_url_filters_against_sql(spark, duck, sf_dir):
    for query, sql in ((quality_rules.op4_quality_rules, quality_rules.OP4_SQL), (url_filters.op2_url_filters, url_filters.OP2_SQL)):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        rel = duck.sql(sql)
        other = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
        key = lambda data: sorted(tuple(repr(r[n]) for n in names) for r in data)
        assert key(df.toArrow().to_pylist()) == key(other)


def test_url_edges(spark):
    caps = spark.createDataFrame([(1, None, None), (2, "http://u@X.spam-farm.example.org.:80/p", "2023-06-01"), (3, "x", "2024-01-01"), (4, "http://spam-farm.example.org", "2024-06-01")], "i long, u string, t string").selectExpr("i", "u", "cast(t as timestamp) t")
    got = {r.id: r.blocked for r in url_filters.judge(caps, url_filters.example_entries(spark), "i", "u", "t").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_classifier(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(300):
        good = k % 2
        w = [rng.choice(["river", "stone", "cloud", "green", "walked", "slowly"]) if good else rng.choice(["BUY!!", "WIN$$", "CLICK##", "NOW!!"]) for _ in range(40)]
        docs.append((k, " ".join(w)))
        labels.append((k, good))
    docs += [(900, None), (901, "")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.id: r.score for r in classifier.score_quality(d, classifier.fit_quality(d, lab)).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.5) == k % 2 for k in held]) > 0.95 and 0 <= got[900] == got[901] <= 1
    none = classifier.fit_quality(d, lab.limit(0))
    assert {r.score for r in classifier.score_quality(d, none).collect()} == {0.5}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard", "suffix_dedup", "pii", "packing"]
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert packed and all(0 < r.length <= 2048 for r in packed)


def test_quality_stage_removes_the_lines_its_verdict_counted_out(spark, sf_dir):
    import corpus_pipeline

    full = [(k, f"unique {chr(97 + k) * (k + 1)} words here to keep this document full enough of text\nthe common footer line", "en", "h", 0) for k in range(15)]
    stubs = [(100 + k, f"stub {chr(97 + k) * (k + 1)}\nthe common footer line", "en", "h", 0) for k in range(15)]
    df = spark.createDataFrame(full + stubs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_stage(spark, df, sf_dir).collect()}
    assert sorted(got) == list(range(15)) and not any("footer" in x for x in got.values())


def test_near_duplicate_stage_against_brute_force(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(4)
    t = texts(160, 8)
    for k in range(20):
        words = [f"d{k}w{i}" for i in range(110)]
        changed = [f"x{k}" if i in (40, 80)[: 1 + k % 2] else w for i, w in enumerate(words)]
        t += [" ".join(words), " ".join(changed), " ".join(w if rng.random() > 0.1 else "y" for w in words)]
    sets = [frozenset(zip(*[x.lower().split()[k:] for k in range(5)])) or (frozenset([tuple(x.lower().split())]) if x.split() else frozenset()) for x in t]
    up = list(range(len(t)))
    for i in range(len(t)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if c == high else c for c in up]
    df = spark.createDataFrame([(k, x, "en", "h", len(x)) for k, x in enumerate(t)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, sf_dir).collect())
    assert got == [k for k, c in enumerate(up) if k == c] and not {161, 164, 167} & set(got)

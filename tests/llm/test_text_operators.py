"""The text operators against brute force, the library or SQL, with nulls, ties, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import bpe, decontam, exactdup, htmltext, pii, secrets, simhash, tokenfile, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _again string, _row int, found string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    extra = [(10_001, None), (10_002, ""), (None, "no key"), (10_003, rows[0][1]), (10_003, rows[0][1]), (10_004, "word " * 30_000)]
    return [(r[0], r[1]) for r in rows] + extra


def got(frame):
    return [tuple(r) for r in frame.collect()]


def test_secrets_equal_regular_expressions(spark, texts):
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")

    def brute(t):
        spans = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        return sorted(spans, key=lambda s: (s[1], secrets.BASE_KINDS.index(s[0])))

    draw = random.Random(1)
    bits = ["password", "Passwd", "SECRET", "token", "apiKEY", "=", ":", " ", '"', "AKIA", "0123456789abcdef", "A", "Z9", "é", "?", "value"]
    made = [(20_000 + i, "".join(draw.choices(bits, k=draw.randint(0, 24)))) for i in range(2_000)]
    rows = texts + made
    for (key, text), row in zip(rows, got(secrets.scan(documents(spark, rows).repartition(1), "doc_id", "text")), strict=True):
        spans = brute(text or "")
        count = Counter(s[0] for s in spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row[:5] == (key, count["assign"], count["access"], count["hex"], hashlib.sha256(joined.encode()).hexdigest())
    assert secrets.secrets_of("-----BEGIN RSA PRIVATE KEY-----") == [("private_key", 0, 31)]
    assert got(secrets.scan(documents(spark, []), "doc_id", "text")) == []


def test_exact_copies(spark, texts):
    rows = documents(spark, texts)
    groups = {}
    for key, text in texts:
        groups.setdefault(text or "", []).append(key)
    found = got(exactdup.decide(rows, "doc_id", "text"))
    best = {t: max((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    text_of = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(found) == len(texts)
    for _, keep, size, _, digest in found:
        assert (keep, size) == (best[text_of[digest]], len(groups[text_of[digest]]))
    assert Counter(text_of[r[4]] for r in found if r[3]) == Counter(groups.keys())
    kept = exactdup.keep_one(rows, "doc_id", "text")
    assert kept.columns == rows.columns
    assert sorted(got(kept.select("doc_id", F.coalesce("text", F.lit("")))), key=repr) == sorted(((k, t) for t, k in best.items()), key=repr)
    assert got(exactdup.decide(documents(spark, []), "doc_id", "text")) == []


def test_a_full_filter_loses_nothing(spark, texts):
    marked = exactdup.flag_repeats(documents(spark, texts), "text", "flag", bits_per_row=1)
    again = Counter(t or "" for _, t in texts)
    assert all(r["flag"] for r in marked.collect() if again[r["text"] or ""] > 1)


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("longest", [24, 2])
def test_simhash_groups(spark, texts, monkeypatch, longest):
    monkeypatch.setattr(simhash, "LONGEST", longest)
    rows = sorted({(k, t or "") for k, t in texts if k is not None})
    found = {r[0]: r[1:] for r in got(simhash.group(documents(spark, rows), "doc_id", "text"))}
    prints = [simhash.fingerprint(t) for _, t in rows]
    for (key, _), print_, root in zip(rows, prints, brute_components(prints), strict=True):
        assert found[key] == (f"{print_:016x}", rows[root][0])


@pytest.mark.parametrize("longest", [24, 2])
def test_links_of_dense_fingerprints(spark, monkeypatch, longest):
    monkeypatch.setattr(simhash, "LONGEST", longest)
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for b in base for _ in range(30)} | {0, 1 << 63})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in signed], "f long")
    roots = dict(got(simhash.components(simhash.links(frame))))
    place = {f: i for i, f in enumerate(signed)}
    want = brute_components(prints)
    classes = {}
    for f, w in zip(signed, want, strict=True):
        classes.setdefault(w, set()).add(roots.get(f, f))
    assert all(len(c) == 1 for c in classes.values()) and len({min(c) for c in classes.values()}) == len(classes)
    assert set(roots) <= set(place)


def test_word_bpe_equals_library(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    draw = random.Random(3)
    bits = [*"abcdeiost 'sdmlr.,!-123", "é", "É", "ß", "İ", "Σ", "́", "日本", "\n", "\t", "\xa0", "<|endoftext|>", "😀", "'LL", "haha", "!!!!"]
    rows = texts + [(30_000 + i, "".join(draw.choices(bits, k=draw.randint(0, 25)))) for i in range(3_000)]
    for (key, text), row in zip(rows, got(bpe.digest(documents(spark, rows).repartition(1), "doc_id", "text", path)), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        assert row == (key, len(ids), *want), text
    codec = bpe.codec(path)
    for letters in ("etaoinshrdlu", "aeb"):
        for _ in range(3_000):
            word = "".join(draw.choices(letters, k=draw.randint(1, 30)))
            assert codec.encode_word(word) == library.encode(word, add_special_tokens=False).ids


def test_token_files_round_trip(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    draw = random.Random(4)
    bits = [*"abc 's.,!-1 23", "é", "\n", "\t", "\xa0", "<|endoftext|>", "😀", " \n", "  ", "\r"]
    rows = [t for t in texts if t[0] is not None] + [(40_000 + i, "".join(draw.choices(bits, k=draw.randint(0, 20)))) for i in range(2_000)]
    found = sorted(got(tokenfile.round_trip(documents(spark, rows), "doc_id", "text", path, end_id=0)), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted(k for k, _ in rows)
    start, text_of = 0, dict(rows)
    for key, first, n, crc in found:
        ids = [*library.encode(text_of[key] or "", add_special_tokens=False).ids, 0]
        assert (first, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert got(tokenfile.round_trip(documents(spark, []), "doc_id", "text", path)) == []


def test_words_of_any_size():
    draw = random.Random(6)
    lists = [
        np.array([draw.getrandbits(draw.choice([1, 3, 8, 16, 31, 60, 64])) for _ in range(draw.choice([0, 1, 5, 4096, 4097, 9000]))], np.uint64)
        for _ in range(30)
    ]
    for ids, (words, offsets, escapes) in zip(lists, tokenfile.pack_all(lists), strict=True):
        assert (tokenfile.unpack(words, escapes) == ids).all()
        for i, start in enumerate(offsets):
            end = offsets[i + 1] if i + 1 < len(offsets) else None
            assert (tokenfile.unpack(words[start:end], escapes) == ids[4096 * i : 4096 * i + 4096]).all()


def test_decontamination_equals_brute_force(spark, sf, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "three short words"), (903, "one two three four five six seven eight nine ten " * 3)]
    near = items[0][1].split()
    rows = texts[:120] + texts[-6:]
    rows += [(50_000, "x y z " + " ".join(near).upper() + " tail"), (50_001, "zz " + " ".join([*near[:-1], "changed"]) + " end"),
             (50_002, "a " + " ".join(near[: len(near) // 2])), (50_003, "Three short, words!"), (50_004, "one two three four five six seven eight nine ten " * 9)]
    look = decontam.Index(tuple((i, t) for i, t in items if i is not None and t is not None))
    want = set()
    for key, text in rows:
        words = decontam.words_of(text or "")
        if len(words) > 5_000:
            continue
        for item, body in items:
            own = decontam.words_of(body or "")
            if not own:
                continue
            size, n = min(5, len(own)), len(own)
            bag = lambda ws: Counter(decontam._shingles(np.array([look.codes.get(w) or decontam.xxhash.xxh64_intdigest(w) for w in ws], np.uint64), size).tolist())  # noqa: E731, B023
            mine = bag(own)
            if not set(mine) & set(bag(words)):
                continue
            if any(look.similarity(bag(words[i : i + n]), mine, size) >= 0.8 for i in range(len(words) - n + 1)):
                want.add((key, item))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    assert {r[:2] for r in got(decontam.leaks(docs, bench))} == want
    assert {(50_000, items[0][0]), (50_001, items[0][0]), (50_003, 902), (50_004, 903)} <= want
    left = decontam.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert Counter(got(left.select("doc_id"))) == Counter((k,) for k, _ in rows if k not in {w[0] for w in want})
    assert len(decontam.passes(bench, "item_id", "text", 200)) > 3
    assert got(decontam.leaks(documents(spark, []), bench)) == got(decontam.leaks(docs, bench.limit(0))) == []


def test_feistel_is_a_permutation():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(i, size, b"key", "t") for i in range(size)) == list(range(size))


def test_pseudonyms(spark, texts):
    text = "Card 4111 1111 1111 1111, not 4111 1111 1111 1112; mail jo.doe7@mail.example.com; 2024-02-29, 31/12/1999, 2023-02-30; " \
        "call +1 (202) 555-0143; 10.1.2.3 and 999.1.1.1; SSN 078-05-1120, 000-12-3456; IBAN GB82 WEST 1234 5698 7654 32; id 1234567"
    names = pii.Pseudonyms(b"k")
    new, spans = pii.pseudonymised(text, names)
    assert Counter(s[2] for s in spans) == {"card": 1, "email": 1, "date": 2, "phone": 1, "ip": 1, "ssn": 1, "iban": 1}
    for start, end, kind, name in spans:
        old = text[start:end]
        assert name != old and old not in new and getattr(names, kind)(name) is not None  # valid in the same format
        if kind != "ip":
            assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", name)) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", old)) or kind == "iban"
    assert all(x in new for x in ("4111 1111 1111 1112", "2023-02-30", "999.1.1.1", "000-12-3456", "1234567"))
    rows = [*texts, (7, text), (8, "again " + text)]
    found = got(pii.replace(documents(spark, rows).repartition(1), "doc_id", "text", b"k"))
    assert found[-2][1] == new and found[-1][1] == "again " + new and len(found) == len(rows)
    assert got(pii.replace(documents(spark, []), "doc_id", "text", b"k")) == []


def test_pages(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a">A</a></ul></nav><!-- x --><div class="ad">Buy &amp; sell</div><article><h1>A &lt;title&gt;</h1><p><b>One<br>two&nbsp; three.
    <p>Four.</p><div class="ad box"><div>buy</div></div><form><input>name</form><p>Five</p></article><section id="comments"><p>reader</p></section><footer>f</footer>"""
    bare = "<div><p>" + "long text here " * 10 + "</p><p>short</p></div><ul><li><a href=x>link text</a></ul>"
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", bare), (4, "u", bare)], "page_id long, url string, html string")
    found = got(htmltext.extract(rows, "page_id", "url", "html"))
    assert found[0] == (1, "u", want := "A <title>\n\nOne two three.\n\nFour.\n\nFive", len(want))
    assert found[1:3] == [(2, "u", "", 0), (3, None, "", 0)]
    assert found[3] == found[4] and found[3][2] == ("long text here " * 10).strip() + "\n\nshort"
    assert got(htmltext.extract(rows.limit(0), "page_id", "url", "html")) == []


def test_pages_with_left_out_and_broken_tags():
    plain = lambda page: htmltext.main_text(page)
    assert plain("<html><head><title>T</title><meta x><p>Body text here.<p>More.") == "Body text here.\n\nMore."
    assert plain('<body><script>var a="<!--";</script><article><p>Hello there.</p></article>') == "Hello there."
    assert plain('<body><article><p class="notice">Ad<p>Real one.</p><div>Two</div></article>') == "Real one.\n\nTwo"
    assert plain('<article><ul><li class="ad">x<li>Keep<li class="share">y</ul><p>After</p></article>') == "Keep\n\nAfter"
    assert plain('<article><ul><li class="ad">x<ul><li>in</ul><li>Keep</ul></article>') == "Keep"
    assert plain('<article><table><tr><td class="ad">x<td>Keep</table>End</article>') == "Keep\n\nEnd"
    long = ("long text " * 20).strip()
    assert plain(f'<body><div class="content-with-sidebar"><p>{long}</p></div>') == long
    assert plain('<article><section id="search"><p>Searching text.</p></section></article>') == "Searching text."
    attributes = " ".join(f'k{i}="v"' for i in range(40))
    assert plain(f"<article><p>x</p><a {attributes} ") == "x"
    for page in ("<a " * 300_000, "<script " * 200_000, '<a x="' * 100_000, "<a x='\" " * 100_000, "<p " + "a=b " * 200_000, "<" * 500_000):
        plain("<article>Kept</article>" + page)  # ends at once, however broken


def test_ids_of_every_byte(spark):
    library = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    coder = tokenfile.Encoder(path)
    texts = [f"a{chr(i)}b {chr(i)} {chr(i)}{chr(i)}word" for i in range(0x300)] + ["".join(map(chr, range(1, 128))), "\x00", "a\x00b\x1b \x7f"]
    for t in texts:
        assert coder.encode(t) == tokenfile.ids_as_bytes(library.encode(t, add_special_tokens=False).ids), t
    words = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    ids = bpe.IdCodec(path)
    ids.WORDS, ids.STRETCHES = 40, 30
    draw = random.Random(6)
    bits = ["a", "B", "é", " ", "\n", "\t", "'s", "1", "<|endoftext|>", "中", "\x00", "!!", "the", "ing", "İ", "\u0301"]
    for t in [*texts, *("".join(draw.choices(bits, k=draw.randrange(30))) for _ in range(1_500))]:
        assert ids.encode(t).tolist() == words.encode(t, add_special_tokens=False).ids, t


def test_toxicity_on_held_out_rows(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choices(["an", "er", "on", "th", "in", "es"], k=draw.randint(1, 4)))
    bad, rows, labels = ["vilest", "scumbag", "rotten"], [], []
    for i in range(600):
        words, toxic = [word() for _ in range(40)], i % 4 == 0
        if toxic:
            words[5], words[20] = draw.choice(bad), draw.choice(bad)
        elif i % 8 == 1:
            words[7:9] = ["rotten", "apple"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1_000, None), (1_001, ""), (1_002, "so v1l3st and sсumbag folk"), (1_003, "a rotten apple"), (None, "x"), (1_004, "er " * 50_000)]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    found = {r[0]: r for r in got(toxicity.score_all(docs, marks, "doc_id", "text"))}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i][1] == (i in held) for i in range(600))
    assert sum(found[i][3] == int(i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert [found[i][3] for i in (1_000, 1_001, 1_002, 1_003, None)] == [0, 0, 1, 0, 0] and all(0 <= r[2] <= 1 for r in found.values())
    left = toxicity.without_toxic(docs, marks, "doc_id", "text")
    assert left.columns == docs.columns and left.count() == sum(r[3] == 0 for r in found.values())
    assert {r[3] for r in got(toxicity.score_all(docs, marks.limit(0), "doc_id", "text"))} == {0}
    assert got(toxicity.score_all(documents(spark, []), marks, "doc_id", "text")) == []


def test_revisits_equal_brute_force(spark):
    draw = random.Random(8)
    rows = []
    for i in range(600):
        url = draw.choice(["http://www.a.org/x/", "https://a.org/x.html#top", "https://a.org/x?utm_source=f", "http://b.org/?b=2&a=1", "http://b.org/?a=1&b=2", None])
        etag, day = draw.choice(["e1", "e2", None]), draw.choice(["d1", None])
        rows.append((i, url, draw.choice([draw.randrange(300), 5]) if i else None, draw.random() < 0.4, etag, day, {"date": str(i), "content-length": "0", "x" + str(i % 3): "v"}))
    rows.append(rows[-1])
    schema = "record_id long, url string, at long, revisit boolean, etag string, modified string, headers map<string,string>"
    keys = {"http://www.a.org/x/": "a.org/x", "https://a.org/x.html#top": "a.org/x", "https://a.org/x?utm_source=f": "a.org/x", None: ""}
    when = lambda r: -1 if r[2] is None else r[2]
    want = []
    for r in rows:
        if r[3]:
            key = keys.get(r[1], "b.org?a=1&b=2")
            full = [f for f in rows if not f[3] and keys.get(f[1], "b.org?a=1&b=2") == key and when(f) < when(r)]
            hit = max(full, key=lambda f: (when(f), f[0]), default=None)
            status, headers = "orphan", None
            if hit:
                agreed = hit[4] == r[4] if hit[4] and r[4] else hit[5] == r[5] if hit[5] and r[5] else None
                status = {None: "unknown", True: "resolved", False: "changed"}[agreed]
                if agreed:
                    headers = tuple(sorted({**hit[6], **{k: v for k, v in r[6].items() if k != "content-length"}}.items()))
            want.append((r[0], key, hit and hit[0], status, headers))
    found = [(*r[:4], r[4] and tuple(sorted(r[4].items()))) for r in got(warc.resolve(spark.createDataFrame(rows, schema)))]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert got(warc.resolve(spark.createDataFrame([], schema))) == []

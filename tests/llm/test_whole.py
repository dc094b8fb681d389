"""Cases in which operators once did less than the whole job."""

import random

import numpy as np
import pytest

from tallymark.llm import decontam, htmltext, jaccard, pii


def near_copies(n_words=60):
    """Texts with edits of several sizes: pairs on both sides of Jaccard 0.8, chains and one large group."""
    roll = random.Random(5)
    word = lambda: f"w{roll.randrange(4000)}"
    texts = ["", None, "one two", "one  TWO", "one two three four five"]
    for k in range(25):
        base = [word() for _ in range(n_words + k)]
        for edits in range(4):
            copy = list(base)
            for at in roll.sample(range(len(copy)), edits):
                copy[at] = word()
            texts += [" ".join(copy), " ".join(copy[: len(copy) - edits])]
    base = [word() for _ in range(200)]
    for _ in range(60):
        copy = list(base)
        for at in roll.sample(range(200), roll.randrange(4)):
            copy[at] = word()
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("counted", [1, 8])
def test_near_copies_equal_brute_force(spark, monkeypatch, counted):
    monkeypatch.setattr(jaccard, "COUNTED", counted)
    rows = list(enumerate(near_copies()))
    sets = [set(jaccard.shingle_set(t or "", {}).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = sorted(i for i in range(len(rows)) if root(i) == i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs, "doc_id", "text").collect()) == want
    assert len(want) < len(rows) / 2


def test_near_copies_by_row(spark):
    base = [f"w{i}" for i in range(80)]
    copy = " ".join([*base[:79], "x"])
    rows = [(1, " ".join(base)), (2, copy), (2, "alone with this key"), (None, copy), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.keep_one(docs, "doc_id", "text").collect()) == [
        (1, " ".join(base)), (2, "alone with this key"), (7, "twice")
    ]
    assert jaccard.keep_one(docs.limit(0), "doc_id", "text").collect() == []


def test_rows_with_their_nulls_in_other_columns_are_judged_each_for_itself(spark):
    """A text was lost with a row of the same key that holds the same word in another column."""
    rows = [(1, None, "x", None), (1, "x", None, [None, "a"]), (2, None, "y", None), (3, "z", None, ["a", None]), (3, "z", None, [None, "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, tags array<string>")
    held = sorted((tuple(r)[:3] for r in jaccard.keep_one(docs, "doc_id", "text").collect()), key=str)
    assert held == [(1, "x", None), (1, None, "x"), (3, "z", None)]
    mapped = spark.createDataFrame([(1, "one two", {"a": None}), (2, "one two", {}), (3, None, None)], "doc_id long, text string, more map<string,string>")
    assert sorted(r["doc_id"] for r in jaccard.keep_one(mapped, "doc_id", "text").collect()) == [1, 3]


def question(seed, n=50):
    roll = random.Random(seed)
    return [f"q{roll.randrange(3000)}" for _ in range(n)]


def found(spark, docs, items, **given):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), **given).collect()
    return sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9), r["first_word"], r["n_words"]) for r in rows)


def test_an_item_less_some_words_is_the_whole_text(spark):
    long, short = question(1), question(2, 15)
    docs = [" ".join(long[:-1]), " ".join(short[1:]), " ".join(long[:-9]), " ".join(long[:-10])]
    assert found(spark, docs, [(1, " ".join(long)), (2, " ".join(short))]) == [
        (0, 1, round(45 / 46, 9), 0, 49), (1, 2, round(10 / 11, 9), 0, 14), (2, 1, round(37 / 46, 9), 0, 41)
    ]


def test_weights_of_items_that_recur(spark):
    text = question(3)
    edited = " ".join(["before", *text[:25], "edit", *text[26:], "after"])
    items = [(i, " ".join(text)) for i in range(10)]
    assert found(spark, [edited], items) == [(0, i, round(41 / 51, 9), 1, 50) for i in range(10)]
    # Items that differ by a head share all else.
    items = [(i, " ".join([f"head{i}", *text])) for i in range(10)]
    assert len(found(spark, [edited.replace("edit ", text[25] + " ")], items)) == 10


def test_blocks_of_the_benchmark_change_nothing(spark):
    text = question(4)
    items = [(i, " ".join([*question(100 + i, 20), *text[: 10 + i]])) for i in range(12)]
    docs = [" ".join([*question(100 + i, 20)[i // 6 :], *text[: 10 + i], "more"]) for i in range(12)]
    one = found(spark, docs, items)
    assert len(one) >= 12
    assert found(spark, docs, items, pass_chars=500) == one


def test_a_text_with_one_value_only():
    names, body = pii.Pseudonyms(b"k"), "ABCDEFGHIJKLMNOP"
    values = {
        "date": ["17/05/1984", "05/17/1984", "17.05.1984", "1984-05-17"], "ip": ["8.8.4.4"], "ssn": ["123-45-6789"],
        "card": ["4111111111111111", "4111 1111 1111 1111"], "phone": ["(555) 123-4567", "+1 555 123 4567", "+15551234567"],
        "iban": [f"MT{pii.iban_check('MT', body):02d}{body}", "GB82 WEST 1234 5698 7654 32"], "email": ["a.b@c.example"],
    }
    for kind, texts in values.items():
        for text in texts:
            new, spans = pii.pseudonymised(f"born {text}.", names)
            assert [s[2] for s in spans] == [kind], text
            assert text not in new
            assert pii.pseudonymised(f"card 4111111111111111, born {text}.", names)[1][-1][2:] == spans[0][2:]


def test_a_linked_paragraph_of_the_article_stays():
    page = "<body><nav><a href=x>Home</a></nav><article><p>First words of the text.</p><p><a href=y>A linked source</a></p><ul><li><a href=z>Another</a></li></ul><p>Last words.</p></article><p><a href=q>Outside</a></p></body>"
    assert htmltext.main_text(page) == "First words of the text.\n\nA linked source\n\nAnother\n\nLast words."
    plain = "<body><p><a href=x>Home of all the links</a></p><p>" + "Words of an unmarked page. " * 8 + "</p></body>"
    assert "Home" not in htmltext.main_text(plain)


def test_sketches_keep_every_pair_of_enough_likeness_and_part_most_others():
    draw = np.random.default_rng(3)
    shut = 0
    for _ in range(400):
        n = int(draw.integers(1, 400))
        a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
        kept = a[draw.random(len(a)) < draw.choice([0.05, 0.8, 0.9, 0.95])]
        b = np.unique(np.concatenate([kept, draw.integers(0, 2**63, int(draw.integers(0, n // 10 + 2)), dtype=np.uint64)]))
        both, differ = len(np.intersect1d(a, b)), sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
        assert differ <= len(a) + len(b) - 2 * both
        if both * 5 >= (len(a) + len(b) - both) * 4:
            assert differ * 9 <= len(a) + len(b)
        else:
            shut += differ * 9 > len(a) + len(b)
    assert shut > 100


def test_a_hot_list_makes_a_pair_once_not_in_every_list_its_members_share(spark, monkeypatch):
    """Sixteen sets near LEAST but apart share 60 common shingles in a row: a pair comes from the first of them alone."""
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    shared = list(range(100, 160))
    nodes = [(i, 200, [0] * (jaccard.SKETCH // 64), [], shared) for i in range(1, 17)]
    kind = "f long, n int, sketch array<long>, rare array<long>, common array<long>"
    seen = {}
    monkeypatch.setattr(jaccard, "verified", lambda rows, text, pairs: seen.setdefault("pairs", pairs).limit(0))
    keep = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda rows, name: seen.setdefault(name, keep(rows, name)))
    jaccard.links(spark.range(0), "id", spark.createDataFrame(nodes, kind))
    hot, apart, tried = (seen[k] for k in ("hot", "apart", "tried"))
    assert apart.count() + tried.count() == 16 * 15 // 2
    joined = hot.alias("x").join(hot.alias("y"), "s").where("x.f > y.f AND NOT x.before <=> y.before")
    assert hot.count() == 16 * 60 and hot.where("before IS NULL").select("s").distinct().count() == 1 and joined.count() == 0

"""License notices: exact and edited copies, spans, defined cases."""
import random

from corpusmill.llm import license_scan as L

INDEX = L.build_index(L.TEMPLATES)


def find(text, **kw):
    return L.find_notices(text.encode(), INDEX, **kw)


def test_every_template_is_found_with_its_span():
    for name, text in L.TEMPLATES.items():
        doc = f"é some words before\n{text}\nand after."
        (got,) = find(doc)
        assert got[1] == got[2], name
        assert got[0] == name and doc[got[3]:got[4]] == text


def test_one_word_changed_left_out_or_put_in():
    """Every template whose share of matching words allows it, at every place."""
    for name, text in L.TEMPLATES.items():
        w = text.split()
        n = len(L._words(text.encode())[0])
        places = range(len(w)) if len(w) < 40 else range(0, len(w), 9)
        for i in places:
            for edit in ([], ["otherword"], [w[i], "otherword"]):
                if len(edit) < 2 and 100 * (n - 1) < L.MIN_PERCENT * n:
                    continue
                got = find("lead words " + " ".join(w[:i] + edit + w[i + 1:]) + " trailing words")
                assert any(100 * x[1] >= L.MIN_PERCENT * x[2] and x[1] >= n - 1 for x in got), (name, i, edit)
    got = find("Released under an MIT License.")
    assert [x[:3] for x in got] == [("mit", 4, 5)]


def test_whole_license_texts():
    for name in ("mit-text", "bsd-2-clause-text", "bsd-3-clause-text", "isc-text"):
        text = "Copyright (c) 2020 Someone\n\n" + L.TEMPLATES[name].lower().replace(". ", ".\n\n    ")
        assert [(x[0], x[1] == x[2]) for x in find(text)] == [(name, True)]


def test_edited_copies_are_aligned():
    rnd = random.Random(1)
    for name in ("apache-2.0-header", "mit-permission", "gpl-notice"):
        for _ in range(20):
            w = L.TEMPLATES[name].split()
            for _ in range(2):
                i = rnd.randrange(len(w))
                w[i:i + 1] = rnd.choice([[], ["other"], [w[i], "extra"]])
            got = find("lead words " + " ".join(w) + " trailing words")
            assert [x for x in got if x[0] == name and x[1] >= 0.85 * x[2]], (name, w)


def full_alignment(doc, template):
    """(score, matched) of the best local alignment, over the whole table."""
    none = (0, 0)
    prev, best = [none] * (len(doc) + 1), none
    for word in template:
        cur = [none]
        for i, w in enumerate(doc):
            s, m = prev[i]
            cell = (s + L.GAIN, m + 1) if w == word else (s - 1, m)
            cell = max(cell, prev[i + 1], (cur[i][0] - 1, cur[i][1]))
            cur.append(cell if cell[0] > 0 else none)
        prev, best = cur, max(best, *cur)
    return best


def test_alignment_equals_full_local_alignment():
    """In a band as wide as the texts nothing is lost, and the span holds the alignment."""
    rnd = random.Random(2)
    for _ in range(300):
        a = [rnd.choice("abcdef").encode() for _ in range(rnd.randrange(1, 30))]
        b = [rnd.choice("abcd").encode() for _ in range(rnd.randrange(1, 9))]
        score, matched = full_alignment(a, b)
        got, first, last = L._align(a, b, -len(b) - 1, len(a) + 1)
        assert got == matched
        if matched:
            assert 0 <= first <= last < len(a) and full_alignment(a[first:last + 1], b) == (score, matched)


def test_runs_of_words_put_in_or_left_out():
    """As many words in one run as the template allows, at every place."""
    for name in ("mit-text", "bsd-3-clause-text", "isc-text", "apache-2.0-header", "gpl-notice"):
        w, own = L.TEMPLATES[name].split(), L.build_index({name: L.TEMPLATES[name]})
        n = len(own["words"][0])
        edits = n - L.needed(n, L.MIN_PERCENT)
        for run in {9, 12, edits // 2, edits}:
            if run > edits:
                continue
            for at in range(0, n - run, 11):
                for doc in (w[:at] + [f"extra{i}" for i in range(run)] + w[at:], w[:at] + w[at + run:]):
                    got = L.find_notices(("lead words here " + " ".join(doc) + " trailing words").encode(), own)
                    assert [x[1] >= L.needed(n, L.MIN_PERCENT) for x in got] == [True], (name, run, at, len(doc))


def test_scattered_edits():
    """Changed, left out and put in words together, up to what the template allows."""
    rnd = random.Random(7)
    for name in ("mit-text", "mit-permission", "bsd-clause", "isc-text", "mpl-2.0"):
        n = len(L._words(L.TEMPLATES[name].encode())[0])
        for _ in range(25):
            w = L.TEMPLATES[name].split()
            for _ in range(rnd.randrange(1, n - L.needed(n, L.MIN_PERCENT) + 1)):
                i = rnd.randrange(len(w))
                w[i:i + 1] = rnd.choice([["zz"], [], [w[i], "zz"]])
            assert name in {x[0] for x in find("some lead " + " ".join(w) + " and more")}, (name, w)


def test_query_equals_brute_force(spark, sf, documents):
    """Every template aligned with every whole document, without index, band or candidates."""
    from corpusmill.llm.queries import op9_license_scan
    got = {}
    for r in op9_license_scan(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start, r.end))
    names = {}
    for i, text in documents:
        doc, _ = L._words((text or "").encode())
        if not 0 < len(doc) < 600:
            continue
        vocabulary = set(doc)
        for name, words in zip(INDEX["names"], INDEX["words"]):
            need = L.needed(len(words), L.MIN_PERCENT)
            if sum(w in vocabulary for w in words) >= need and full_alignment(doc, words)[1] >= need:
                names.setdefault(i, set()).add(name)
    small = {i for i, t in documents if t and 0 < len(L._words(t.encode())[0]) < 600}
    # the query reports the best of overlapping notices, so it has one wherever there is any
    assert {i for i in got if i in small} == set(names)
    assert all({x[0] for x in got[i]} <= names[i] for i in names)


def test_frames(make_docs):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "nothing here"), (4, f"{mit} x {mit}"), (None, mit), (4, "***Released&&& under the%%% MIT*** License.###"),
            (5, "word " * 40000 + mit)]
    got = [(r.doc_id, r.license, r.coverage) for r in L.scan(make_docs(rows).selectExpr("*", "1 as license")).collect()]
    assert got == [(4, "mit", 1.0), (4, "mit", 1.0), (None, "mit", 1.0), (4, "mit", 1.0), (5, "mit", 1.0)]
    assert L.scan(make_docs([])).count() == 0
    assert L.scan(make_docs(rows), templates={"blank": " ", "two": "nothing here"}).collect()[0].license == "two"

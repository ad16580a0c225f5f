import random
from collections import Counter

from obsweave.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(text, n, letters="abcd"):
    out = list(text)
    for _ in range(n):
        kind, at = random.random(), random.randrange(len(out) + 1)
        if kind < 0.35:
            out.insert(at, random.choice(letters))
        elif kind < 0.7 and len(out) > 4:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = random.choice(letters)
    return "".join(out)


def test_banded_distance():
    random.seed(1)
    for _ in range(20_000):
        k, a = random.randint(0, 4), "".join(random.choices("abc", k=random.randint(0, 14)))
        b = edited(a, random.randint(0, 5), "abc")
        assert ld.within(a, b, k) == min(distance(a, b), k + 1), (a, b, k)


def test_lines_within_the_threshold_share_a_key():
    random.seed(2)
    for _ in range(5000):
        k, a = random.randint(1, 3), "".join(random.choices("abcd", k=random.randint(4, 25)))
        a, b = sorted((a, edited(a, k)), key=len)
        if len(a) > k and distance(a, b) <= k:
            assert {x for x, p in ld._keys(a, k, 1) if not p} & {x for x, p in ld._keys(b, k, 1) if p}, (a, b, k)


def brute(docs, k, least):
    lines = [(i, n, x.strip(" \t\x0b\f\r")) for i, t in docs for n, x in enumerate((t or "").split("\n"))]
    lines = sorted(x for x in lines if len(x[2]) >= least)
    group = {x: x for _, _, x in lines}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x
    distinct = sorted(group)
    for x in distinct:
        for y in distinct:
            if x < y and abs(len(x) - len(y)) <= k and distance(x, y) <= k:
                group[top(x)] = top(y)
    seen, gone = set(), {i: set() for i, _ in docs}
    for i, n, x in lines:
        if top(x) in seen:
            gone[i].add(n)
        seen.add(top(x))
    return {i: ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]), len(gone[i])) for i, t in docs}


def test_removed_lines_equal_brute_force(rows):
    random.seed(3)
    base = ["".join(random.choices("abcd ", k=random.randint(8, 40))) for _ in range(60)]
    hot = "x" + base[0]
    docs = []
    for i in range(50):
        lines = [edited(random.choice(base), random.randint(0, 4)) for _ in range(random.randint(0, 6))] + [edited(hot, random.randint(0, 2))]
        docs.append((i, "\n".join(lines)))
    got = ld.without_repeated_lines(rows("doc_id long, text string", *docs), 2, 10).collect()
    want = brute(docs, 2, 10)
    assert {r["doc_id"]: (r["text"], r["removed_lines"]) for r in got} == want
    assert sum(n for _, n in want.values()) > 50


def test_odd_documents(odd_documents, no_documents):
    done = ld.without_repeated_lines(odd_documents).collect()
    assert Counter(r["doc_id"] for r in done) == Counter(r["doc_id"] for r in odd_documents.collect())
    texts = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in done}
    assert texts[0] == (None, 0) and texts[1] == ("", 0) and texts[5][1] == 0
    assert texts[6][1] == 2 and texts[10] == ("", 3)  # the second text with these lines loses all of them
    assert sum(r["doc_id"] == 6 and r["removed_lines"] == 2 for r in done) == 2  # a repeated row is one document
    assert ld.without_repeated_lines(no_documents).count() == 0


def test_short_lines_repeat_exactly_and_edits_follow_length(rows):
    short, middle, long = "All rights reserved.", "Terms of use and privacy notes", "the same line of a text that is long enough"
    docs = [
        (1, f"{short}\nTitle\n---\n{middle}\n{long}"), (2, f"own words\n{short}\n Title \n---\n\n"), (3, f"Titles\n{middle[1:]}\n{long[2:]}"),
        (4, f"{middle[2:]}\n{long[1:]}\nTitle"),
    ]
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in ld.without_repeated_lines(rows("doc_id long, text string", *docs)).collect()}
    assert got[1] == (docs[0][1], 0)
    assert got[2] == ("own words\n---\n\n", 2)  # a line without a word stays
    assert got[3] == ("Titles", 2)
    assert got[4] == ("", 3)  # each line is one edit from one that fell


def test_every_length_equals_brute_force(rows):
    random.seed(5)
    base = ["".join(random.choices("abcd", k=random.choice([1, 3, 8, 18, 19, 20, 21, 22, 38, 39, 40, 41, 42, 43]))) for _ in range(40)]
    docs = [(i, "\n".join(edited(random.choice(base), random.choice([0, 0, 1, 1, 2, 3])) for _ in range(6))) for i in range(50)]
    lines = [(i, n, x) for i, t in docs for n, x in enumerate(t.split("\n")) if x]
    group = {x: {x} for _, _, x in lines}
    for x in list(group):
        for y in list(group):
            most = min(2, min(len(x), len(y)) // 20)
            if x < y and group[x] is not group[y] and abs(len(x) - len(y)) <= most and distance(x, y) <= most:
                group[x] |= group[y]
                for z in group[y]:
                    group[z] = group[x]
    seen, gone = set(), set()
    for i, n, x in lines:
        if id(group[x]) in seen:
            gone.add((i, n))
        seen.add(id(group[x]))
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs}
    got = ld.without_repeated_lines(rows("doc_id long, text string", *docs)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want


def test_narrower_keys_lose_no_pair():
    random.seed(6)
    for _ in range(200):
        k, a = random.randint(1, 2), "".join(random.choices("abcd", k=random.randint(5, 60)))
        a, b = sorted((a, edited(a, random.randint(1, k))), key=len)
        if a == b or distance(a, b) > k:
            continue
        x, y = ({(key, w) for key, p, w in ld.whole(len(t), k, 1) if p == probe} for t, probe in ((a, False), (b, True)))
        for _ in range(2):
            x = {(key, tuple(left)) for old, w in x for key, left in ld.narrower_keys(a, old, False, w, k, 1)}
            y = {(key, tuple(left)) for old, w in y for key, left in ld.narrower_keys(b, old, True, w, k, 1)}
            both = {key for key, _ in x} & {key for key, _ in y}
            assert both, (a, b, k)
            x, y = ({z for z in entries if z[0] in both} for entries in (x, y))


def test_lines_with_a_common_passage_are_not_all_compared(rows, monkeypatch):
    random.seed(7)
    passage = "".join(random.choices("abcd ", k=60))
    heads = ["".join(random.choices("abcdefgh", k=30)) for _ in range(150)]
    heads += [edited(h, 2) for h in heads[:20]]
    lines = [h + passage for h in heads]
    compared, verified = [], ld.verified
    monkeypatch.setattr(ld, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    got = ld.without_repeated_lines(rows("doc_id long, text string", *enumerate(lines)), 2, 10).collect()
    want = brute(list(enumerate(lines)), 2, 10)
    assert {r["doc_id"]: (r["text"], r["removed_lines"]) for r in got} == want
    assert sum(n for _, n in want.values()) >= 15
    assert sum(compared) < 10 * len(lines)  # of 14,365 pairs

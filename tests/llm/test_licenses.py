import re

from parcelworks.llm import licenses as L
from parcelworks.llm.common import table


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scanner():
    words = L.template_words()
    return L.Scanner(1000, {w: 900 if w in (b"the", b"of", b"is") else 3 for w in words})


def test_notices_and_phrases():
    s = scanner()
    filler = "lorem ipsum of the dolor " * 30
    for t in L.TEMPLATES:
        labels = s.scan(f"{filler} {t.text} {filler}")[5].split(",")
        assert t.label in labels, t
    assert s.scan("GNU general public-license")[4:6] == ("gpl", "gpl")
    assert s.scan("Released under the Apache licence, version two")[4:] == ("", "", 0.0)
    assert s.scan("licensed under the GNU General Public License, version 2 or later")[5] == "gpl,gpl-2.0"
    assert s.scan("cc cc by by cc by")[1:4] == (2, 1, 4)
    for text in (None, "", "...", "cc\x00by\x7fMIT Licensé", "x" * 100000):
        assert s.scan(text)[:5] == brute(text)


def test_every_document_against_plain_search(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: tuple(r)[1:] for r in L.op2(spark, "/root/testdata/sf0.01").collect()}
    for r in docs.collect():
        row = got[r.doc_id]
        assert row[:5] == brute(r.text)
        assert set(filter(None, row[4].split(","))) <= set(row[5].split(",")) and 0 <= row[6] <= 1
    assert sum(bool(r[5]) for r in got.values()) > 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "MIT License", "x"), (1, "MIT License", "y"), (None, "", "z")], "doc_id long, text string, labels string")
    assert sorted((r.n_base, r.labels) for r in L.scanned(docs).collect()) == [(0, ""), (0, ""), (1, "mit"), (1, "mit")]
    assert L.scanned(docs.limit(0)).count() == 0


def test_many_notices_in_one_file():
    s, filler = scanner(), " lorem ipsum of the dolor "
    every = [t.text for t in L.TEMPLATES]
    for parts in (every, every[::-1]):
        assert {t.label for t in L.TEMPLATES} <= set(s.scan(filler.join(parts))[5].split(","))
    some = {}
    for t in L.TEMPLATES:  # of several texts with a label the longest
        some[t.label] = max(some.get(t.label, ""), t.text, key=len)
    found = set(s.scan(filler.join(some[x] for x in ("bsd-3-clause", "mit", "apache-2.0", "gpl-3.0")))[5].split(","))
    assert {"apache-2.0", "bsd-3-clause", "gpl", "gpl-3.0", "mit"} <= found
    assert not any(x.startswith(("cc", "isc", "lgpl", "agpl", "mpl", "zlib", "unlicense")) for x in found)
    found = set(s.scan(filler.join(some[x] for x in ("bsd-2-clause", "isc")) + " Licensed under CC BY-NC 4.0.")[5].split(","))
    assert {"bsd-2-clause", "cc-by", "cc-by-nc-4.0", "isc"} <= found and "cc-by-4.0" not in found


def brute_labels(s, words):
    """Labels by trying every template at every place, straight from the rule."""
    found = set()
    for t, (label, own, keys) in enumerate(s.templates):
        for start in range(-len(own), len(words) + 1):
            near = words[max(0, start - s.slack) : max(0, start + len(own) + s.slack)]
            stand = sum(s.idf[w] for i, w in enumerate(own) if w in words[max(0, start + i - s.slack) : max(0, start + i + s.slack + 1)])
            whole = all(any(near[i : i + len(k)] == k for i in range(len(near))) for k in keys)
            if whole and stand >= s.coverage * s.whole[t]:
                found.add(label)
                break
    return found


def in_order_labels(s, words):
    """Labels of long templates enough of whose words stand in order anywhere in the text, with their key phrases; by the plain table."""
    found = set()
    for t, (label, own, keys) in enumerate(s.templates):
        best = [0.0] * (len(words) + 1)
        for w in own:
            new = [0.0]
            for j, x in enumerate(words):
                new.append(max(new[-1], best[j + 1], best[j] + s.idf[w] if x == w else 0.0))
            best = new
        there = all(any(words[i : i + len(k)] == k for i in range(len(words))) for k in keys)
        if len(own) >= L.LONG and there and best[-1] >= s.coverage * s.whole[t] - 1e-9:
            found.add(label)
    return found


def without_keys(s, t, places):
    """Whether no key phrase of the template stands at the places."""
    _, own, keys = s.templates[t]
    return all(not set(range(i, i + len(k))) & set(places) for k in keys for i in range(len(own)) if own[i : i + len(k)] == k)


def test_altered_texts():
    s, filler, tried = scanner(), "lorem ipsum of the dolor " * 30, 0
    organisation = "the regents of the university of some large state and others".split()
    for t, (label, own, keys) in enumerate(s.templates):
        if len(own) < L.LONG:
            continue
        own = [w.decode() for w in own]
        texts = []
        for share in (0.3, 0.5, 0.7):
            at = int(len(own) * share)
            while not without_keys(s, t, [at - 1]) and not without_keys(s, t, [at]) and at < len(own):
                at += 1
            texts.append(own[:at] + "ten words that do not belong to it at all".split() + own[at:])
            if len(own) > 60 and without_keys(s, t, range(at, at + 10)):
                texts.append(own[:at] + own[at + 10 :])
        joined = " ".join(own).replace("copyright holder ", " ".join(organisation) + " ")
        texts.append(joined.split())
        texts.append(joined.replace("copyright holders", " ".join(organisation)).split())
        for text in texts:
            labels = s.scan(f"{filler} {' '.join(text)} {filler}")[5].split(",")
            assert label in labels, (label, " ".join(text))
            assert label != "bsd-3-clause" or "bsd-2-clause" not in labels
            tried += 1
    assert tried > 60


def test_identifiers():
    s = scanner()
    for text, label in (("// SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"), ("# under GPLv3", "gpl-3.0"), ("license = Apache-2.0", "apache-2.0"), ("(LGPLv2.1)", "lgpl-2.1")):
        assert label in s.scan(text)[5].split(","), text
    assert s.scan("identifier of the permit 2 0")[5] == ""


def test_labels_against_every_template_at_every_place():
    import random

    s, rng = scanner(), random.Random(3)
    for _ in range(25):
        words = []
        for t in rng.sample(L.TEMPLATES, 2):
            own = L.alnum_words(t.text)
            for _ in range(rng.randrange(1 + len(own) // 6)):
                own[rng.randrange(len(own))] = rng.choice([b"the", b"x", b"license"])
            words += own[rng.randrange(3) :] + [b"z"] * rng.randrange(4)
        got = s.scan(b" ".join(words).decode())
        labels, rigid = set(filter(None, got[5].split(","))), brute_labels(s, words) | set(filter(None, got[4].split(",")))
        assert rigid <= labels <= rigid | in_order_labels(s, words)


def test_lookup_against_every_place():
    import random

    s, rng = scanner(), random.Random(7)
    for _ in range(20):
        words = []
        for t in rng.sample(L.TEMPLATES, 4):
            own = L.alnum_words(t.text)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice([b"the", b"x", b"license"])
            if rng.random() < 0.3:
                own.insert(rng.randrange(len(own)), b"y")
            words += own + [b"z"] * rng.randrange(6)
        everywhere = {(t, i) for t in range(len(L.TEMPLATES)) for i in range(-len(s.templates[t][1]), len(words))}
        candidates, _ = s.looked_up(words)
        assert set(s.occurrences(words, candidates)) == set(s.occurrences(words, everywhere))

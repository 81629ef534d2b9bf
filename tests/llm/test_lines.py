from parcelworks.llm import lines as L


def brute(rows, ratio, least):
    from collections import Counter

    pages, seen = Counter(), Counter()
    for _, text, host in rows:
        if host is not None:
            pages[host] += 1
            for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
                seen[host, line] += 1
    out = []
    for doc_id, text, host in rows:
        if text is None:
            out.append((doc_id, None))
            continue
        own = text.split("\n")
        stay = [x for x in own if not (host is not None and seen[host, x.strip(" \t\r")] >= least and seen[host, x.strip(" \t\r")] > ratio * pages[host])]
        out.append((doc_id, "\n".join(stay if any(x.strip(" \t\r") for x in stay) else own)))
    return out


def test_against_plain_rule(spark, monkeypatch):
    rows = [(i, f"head\nbody {i % 7}\n\n foot \n{'rare' if i == 3 else ''}", "a") for i in range(20)]
    rows += [(30 + i, f"head\nother {i}\nbody 1", "b") for i in range(2)]
    rows += [(40, None, "a"), (41, "", "a"), (42, "head\nfoot", "a"), (43, "head\nx", None), (44, "head\r\n" * 50 + "y", "a"), (44, "head\nx", "a"), (None, "\n\n", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(brute(rows, 0.2, 3), key=str)
    import parcelworks.llm.common as C

    for bound in (C.BROADCAST_BYTES, -1):
        monkeypatch.setattr(L, "broadcast_if_small", lambda frame, size, bound=bound: C.broadcast_if_small(frame, size, bound))
        got = L.dedup_lines(docs, ratio=0.2)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    assert any("head" not in (t or "") for _, t in want)
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", "s", "x", 3)], "doc_id long, text string, source string, host string, n_chars long")
    assert [tuple(r) for r in L.dedup_lines(docs.withColumn("lines", docs.text)).collect()] == [(1, "a\nb", "s", "x", 3, "a\nb")]

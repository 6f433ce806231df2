from collections import Counter, defaultdict

from quaestor.llm.lines import dedup_lines

SCHEMA = "doc_id long, text string, source string, site string, lines long, _n_dropped string"


def brute(rows, max_ratio, min_pages):
    pages, holds = Counter(), defaultdict(Counter)
    for _, text, source in rows:
        pages[source] += 1
        holds[source].update({x.strip(" \t\r") for x in (text or "").split("\n")} - {""})
    out = []
    for i, text, source in rows:
        bad = {x for x, n in holds[source].items() if n >= min_pages and n > pages[source] * max_ratio}
        kept = [x for x in (text or "").split("\n") if x.strip(" \t\r") not in bad]
        out.append((i, None if text is None else "\n".join(kept)))
    return out


def test_equals_brute_force(spark):
    rows = [(i, f"Menu | Home \n\nbody {i}\nbody {i}\n" + ("footer\t" if i % 3 else "rare") + f"\nline {i % 7}", "abc"[i % 2]) for i in range(120)]
    rows += [(200, None, "a"), (201, "", "a"), (202, "\n\n", None), (203, "Menu | Home", None), (203, "Menu | Home", None), (203, " Menu | Home\r", None)]
    rows += [(None, "x\n" * 30000 + "Menu | Home", "b"), (205, "lonely", "z"), (206, "a\nMenu | Home\n", "b")]
    df = spark.createDataFrame([(i, t, s, "q", 5, "w") for i, t, s in rows], SCHEMA)
    for ratio, least in ((0.05, 3), (0.5, 3), (0.1, 1)):
        out = dedup_lines(df, max_ratio=ratio, min_pages=least)
        assert out.columns == ["doc_id", "text", "source", "site", "lines", "_n_lines", "_n_dropped"]
        got = out.collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, brute(rows, ratio, least)))
        by = {r.doc_id: r for r in got}
        assert by[200].text is None and by[200]["_n_lines"] == 0
        assert all((r.text or "").count("\n") + 1 <= max(r["_n_lines"], 1) for r in got)


def test_copies_once(spark):
    rows = [(i, f"Menu\nbody {i}", "a") for i in range(940)] + [(1000 + i, "first line\nsecond line", "a") for i in range(60)]
    # Three copies in a small site; near copies that lack one line each; a page of boilerplate only, two whole rows of it equal.
    rows += [(2000 + i, "few pages", None) for i in range(3)]
    near = ["\n".join(f"near {k}" for k in range(8) if k != i) for i in range(8)]
    rows += [(3000 + 10 * i + k, t, "n") for i, t in enumerate(near) for k in range(2)]
    rows += [(4000, "Menu", "a"), (4000, "Menu", "a"), (4001, "Menu", "a"), (4002, None, "a"), (4003, "\n", "a")]
    df = spark.createDataFrame([(i, t, s, "q", 5, "w") for i, t, s in rows], SCHEMA)
    got = dedup_lines(df, copies_once=True).collect()
    assert len(got) == len(rows) and not any(r["_n_dropped"] for r in got if 1000 <= (r.doc_id or 0) < 1060)
    texts = defaultdict(list)
    for r in got:
        texts[r.doc_id].append(r.text)
    assert all(texts[i] == [f"body {i}"] for i in range(940))
    assert all(texts[i] == ["first line\nsecond line"] for i in range(1000, 1060))
    assert all(texts[2000 + i] == ["few pages"] for i in range(3))
    for i, t in enumerate(near):
        assert sorted(texts[3000 + 10 * i] + texts[3001 + 10 * i]) == ["", t]
    assert sorted(texts[4000] + texts[4001]) == ["", "", "Menu"]
    assert texts[4002] == [None] and texts[4003] == ["\n"]
    assert dedup_lines(spark.createDataFrame([], SCHEMA), copies_once=True).count() == 0


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0

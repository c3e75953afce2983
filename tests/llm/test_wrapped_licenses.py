"""Licence notices wrapped over lines, led by comment signs."""

from __future__ import annotations

import textwrap

from tidewire.llm import licenses as li

NOTICES = {"Apache-2.0": (4, 5, 6, 7), "BSD-3-Clause": (16, 17, 18, 19), "BSD-2-Clause": (16, 17, 18), "MIT": (14, 15), "ISC": (20,), "GPL-3.0-or-later": (21,), "GPL-2.0-or-later": (22,)}


def test_wrapped_notices(spark):
    rows, want = [], {}
    for name, ids in NOTICES.items():
        for width in (72, 76, 80):
            for sign in ("", "# ", " * ", "// ", "-- "):
                lines = []
                for k in ids:
                    lines += [*textwrap.wrap(li.SENTENCES[k], width - len(sign)), ""]
                n = len(rows)
                rows.append((n, "/*\nCopyright 2020 X\n" + "\n".join((sign + x).rstrip() for x in lines) + "\n*/\ncode = 1"))
                want[n] = (name, "".join(f"<{k}>" for k in ids))
    n = len(rows)
    header = textwrap.fill(" ".join(li.SENTENCES[k] for k in (4, 6, 7)), 76)
    more = [(header, "Apache-2.0", "<4><6><7>"), ("A title\nReleased under the MIT License\nmore prose", "MIT", "<1>"), ("Released under\n\nthe MIT License.", "", ""), ("It is not Released under the\nMIT License.", "", "")]
    for k, (text, name, ids) in enumerate(more):
        rows.append((n + k, text))
        want[n + k] = (name, ids)
    got = {r["doc_id"]: (r["licenses"], r["sentence_ids"]) for r in li.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


HEADS = {
    "Copyright (c) 2020 X. All rights reserved.\n\n": ("", "<28>"), "(c) Copyright 2020, X and others.\nAll rights\nreserved.\n": ("", "<28>"),
    "All rights reserved.\n": ("Proprietary", "<13>"), "Copyright 2020 X\n": ("", ""),
}


def rows_and_results():
    rows, want = [], {}
    for head, (more, first) in HEADS.items():
        for name, ids in NOTICES.items():
            for width, sign in ((80, ""), (72, "# ")):
                body = "\n".join(f"{sign}{line}".rstrip() for k in ids for line in [*textwrap.wrap(li.SENTENCES[k], width), ""])
                n = len(rows)
                rows.append((n, head + body))
                want[n] = (",".join(x for x in (name, more) if x), first + "".join(f"<{k}>" for k in ids))
        rows.append((len(rows), head + "Nothing else."))
        want[len(rows) - 1] = (more or ("Proprietary" if first else ""), first)
    return rows, want


def test_a_copyright_line_is_no_licence_beside_another(spark):
    rows, want = rows_and_results()
    found = li.scan_licenses(spark.createDataFrame(rows + rows[:3], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["licenses"], r["sentence_ids"]) for r in found} == want and len(found) == len(rows) + 3


def test_the_sql_finds_the_same_in_wrapped_notices(spark):
    import duckdb
    import pandas as pd

    rows, _ = rows_and_results()
    texts = [(*r,) for r in rows]
    for width in (60, 76):
        for sign in ("", "// ", " * "):
            for ids in NOTICES.values():
                texts.append((len(texts), "Some prose here; and more.\n" + "\n".join(sign + x for k in ids for x in [*textwrap.wrap(li.SENTENCES[k], width), ""]) + "\r\nReleased under the MIT License"))
    texts += [(len(texts), None), (len(texts) + 1, ""), (len(texts) + 2, "Released under\n\nthe MIT License. x"), (len(texts) + 3, "a. Licensed under CC BY 4.0. b\n" * 500)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(texts, columns=["doc_id", "text"]))
    want = {r[0]: r[1:] for r in con.execute(li.OP4_SQL).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in li.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want

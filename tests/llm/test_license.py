import duckdb

from evigrain.llm import license_scan as s


def brute(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    cls = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    ws = re.findall(cls, low)
    at, base = [], set()
    for label, p in s.PHRASES.items():
        q = p.split()
        hits = [i for i in range(len(ws)) if ws[i : i + len(q)] == q]
        at += hits
        base |= {label} if hits else set()
    own, best = set(), 0.0
    for line in low.split("\n"):
        block = set(re.findall(cls, line))
        for label, t in s.TEMPLATES:
            t = set(t.split())
            if len(t & block) >= s.CONTAINMENT * len(t) - 1e-9:
                own.add(label)
                best = max(best, len(t & block) / len(t))
    return (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if at else best)


TEXTS = [
    None,
    "",
    "\n\n ",
    "Released under the MIT License.\nother words",
    "under the mit\nlicense",
    "x under-the.MIT license under the mit license",
    "APACHE License, Version 2.0 and CC BY-NC 4.0",
    "apache license version 20",
    "this work is licensed under the gnu general public license",
    "Ünder the mit license; all RIGHTS reserved",
    "rights reserved",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files",
    ("word " * 60_000) + "under the mit license",
    "İ K under the mit license",
]


def test_against_brute_force(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(0, None, "c"), (3, TEXTS[3], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = s.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:-1] == brute(TEXTS[r.doc_id])[:-1] and abs(r.score - brute(TEXTS[r.doc_id])[-1]) < 1e-12
    assert s.scan(df.limit(0)).count() == 0


def test_sql_gives_the_same(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf_dir}/documents.parquet'")
    got = s.op1_license_scan(spark, sf_dir)
    want = con.sql(s.ORACLE_SQL)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda row: tuple(str(x) for x in row)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted(want.select(*cols).fetchall(), key=key)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = s.op1_license_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal",
    "bsd": "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:",
    "gpl-3": "This program is free software: you can redistribute it\r\n# and/or modify it under the terms\r\n#\r\n# of the GNU General Public License as",
    "mpl-2": "This\nSource\nCode\nForm\nis\nsubject\nto\nthe\nterms\nof\nthe\nMozilla\nPublic\nLicense,\nv. 2.0.",
}


def test_notices_over_line_ends(spark):
    rows = list(enumerate(WRAPPED.values())) + [(10 + i, f"other words before\n\n{t}\nand after\n") for i, t in enumerate(WRAPPED.values())]
    far = "\n".join(("this source code form is subject to", "filler " * 60, "the terms of the mozilla public license v 2 0"))
    rows += [(20, far), (21, "all\n" + "filler " * 60 + "\nrights reserved")]
    got = {r.doc_id: r.labels for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(WRAPPED)), **{10 + i: k for i, k in enumerate(WRAPPED)}, 20: "", 21: ""}

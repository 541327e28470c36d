from seepage.llm import licenses as L


def test_units_and_spellings(spark):
    rows = [
        (1, "prose line\nLicensed under the Apache Licence, version 2.0!\nmore"),
        (2, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + L.MIT.replace(", ", ",\n").upper()),
        (3, "Copyright (c) 1999 X\n" + L.ISC),
        (4, "© 2001 someone\n  released under the mit license  \n\n\nother"),
        (5, None), (6, ""), (7, "..."), (8, "the MIT license is nice"), (9, "word " * 100_000 + "\nLicensed under CC BY-NC 4.0."),
        (10, "Released under the MIT License.\nReleased under the MIT License."), (10, "Released under the MIT License."), (None, "Licensed under CC0 1.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS scope", "3 AS c")
    got = {(r.doc_id, r.license_id, r.scope): r.n for r in L.scan(df).collect()}
    assert got[1, "Apache-2.0", "line"] == 1 and (1, "Apache-2.0", "text") not in got
    assert got[2, "MIT", "text"] == 1 and got[3, "ISC", "text"] == 1
    assert got[4, "MIT", "line"] == 1 and got[4, "MIT", "paragraph"] == 1
    assert not [k for k in got if k[0] in (5, 6, 7, 8)]
    assert got[9, "CC-BY-NC-4.0", "line"] == 1 and got[10, "MIT", "line"] == 3 and got[None, "CC0-1.0", "text"] == 1
    assert L.scan(df.limit(0)).count() == 0


def test_licences_between_paragraphs(spark):
    rows = [(1, "Some prose.\n\n" + L.MIT + "\n\nMore prose."), (2, "Prose\n\n" + L.BSD3.upper() + "\n\n" + L.BSD3), (3, L.BSD2), (4, "a\n\n" + L.MIT.split("\n\n")[0] + "\n\nb"), (5, "our text\n\nits second part"), (6, "x\n\nOur Text!\n\nits second part\n\ny"), (7, L.UNLICENSE), (8, "p\n\n" * 3000 + L.ISC)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license_id, r.scope): r.n for r in L.scan(df, more=[("own", "our text\n\nits second part")]).collect()}
    assert got[1, "MIT", "run"] == 1 and (1, "MIT", "text") not in got
    assert got[2, "BSD-3-Clause", "run"] == 2 and not [k for k in got if k[0] == 4 and k[2] != "paragraph"]
    assert got[3, "BSD-2-Clause", "text"] == got[3, "BSD-2-Clause", "run"] == 1
    assert got[5, "own", "text"] == got[6, "own", "run"] == 1 and got[7, "Unlicense", "text"] == 1 and got[8, "ISC", "run"] == 1


def test_sql_agrees(spark):
    import duckdb

    rows = [(1, "Copyright 2020\n" + L.ZLIB), (2, "a\n \nLicensed under the ISC Licence.\n\nb"), (3, L.APACHE_NOTICE.replace("\n", "\n\n")), (4, "SPDX-License-Identifier:   MIT"), (5, "prose\n\n" + L.BSD2 + "\n\nend"), (5, "prose\n\n" + L.BSD2), (6, None), (7, L.WTFPL)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    documents = df.toPandas()  # noqa: F841  (read by DuckDB)
    want = duckdb.sql(L.OP6_SQL).fetchall()
    assert sorted(map(tuple, L.scan(df).select("doc_id", "license_id", "scope", "n").collect())) == sorted(want)
    assert len(want) > 5


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

"""Quotation linking and licence lookup."""

import random
import re
import textwrap
import time
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from tests.compare import connect, difference
from tests.llm.conftest import multiset
from triagekit.llm import licences, oracles, queries, quotes

MAIL = [
    (1, 0, "Shall we meet?\n\nBring the   Papers."),
    (1, 1, "> shall we meet?\n>\n> bring the papers.\nYes, at noon.", ),
    (1, 2, "> > Shall we meet?\n> Yes, at noon.\n\nFine."),
    (1, 3, ">> bring the papers.\nNo level one here."),
    (2, 0, "Shall we meet?"),
    (2, 1, "> Yes, at\n> noon.\nI read this elsewhere."),
    (2, 2, "> nobody wrote this\nHm."),
    (3, 0, None),
    (3, 1, "> later words\n"),
    (3, 2, "later words"),
    (None, 5, "> Shall we meet?\nno conversation"),
    (4, None, "> Fine.\nno turn"),
    (5, 0, "twice"),
    (5, 0, "twice"),
    (5, 1, "> twice\nanswer"),
]


def linked(spark, rows=MAIL):
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("digest", F.lit(1)).withColumn("level", F.lit("x"))
    return quotes.reply_conversations(df)


def test_links_and_order(spark):
    got = {(r.conv_id, r.turn): r for r in linked(spark).collect()}
    links = {k: (r.parent_conv, r.parent_turn, r.thread_conv, r.thread_turn, r.depth, r.n_quoted, r.n_linked) for k, r in got.items()}
    assert links[1, 0] == (None, None, 1, 0, 0, 0, 0)
    assert links[1, 1] == (1, 0, 1, 0, 1, 2, 2)
    assert links[1, 2] == (1, 1, 1, 0, 2, 2, 2)
    assert links[1, 3] == (None, None, 1, 3, 0, 1, 1)
    assert links[2, 1] == (1, 1, 1, 0, 2, 1, 1)
    assert links[2, 2] == (None, None, 2, 2, 0, 1, 0)
    assert links[3, 1] == (None, None, 3, 1, 0, 1, 0)  # written only later
    assert links[None, 5][:5] == (None, None, None, 5, 0)
    assert links[4, None][:2] == (1, 2) and links[4, None][4] == 3  # another conversation, named before
    assert links[5, 1][:5] == (5, 0, 5, 0, 1)
    assert got[1, 1].own_text == "Yes, at noon." and got[3, 0].own_text == "" and got[1, 0].own_text.endswith("Papers.")


def test_every_row_is_returned(spark):
    assert linked(spark).count() == len(MAIL)
    assert linked(spark, []).count() == 0


def test_long_chains(spark):
    rows = [(1, i, (f"> message {i - 1}\n" if i else "") + f"message {i}") for i in range(70)]
    got = sorted((r.turn, r.depth, r.thread_turn) for r in linked(spark, rows).collect())
    assert got == [(i, i, 0) for i in range(70)]


def test_licences(spark):
    mit = licences.KNOWN[1][1]
    rows = [
        (1, mit), (2, mit.upper().replace(",", " ,")), (3, "MIT License? no\n" + mit), (4, "Copyright (c) 2020 Someone\nAll rights reserved.\n" + mit),
        (5, mit.replace("COPYRIGHT HOLDERS", "copyright   owners")), (6, None), (7, ""), (8, "© 1999 me"),
        (9, "words\nlicensed under the apache licence version 2.0\nReleased under the MIT License!"), (9, "words"), (None, mit),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("licence", F.lit("y"))
    known = licences.known_licences(spark)
    got = multiset((r.doc_id, r.licence, r.notices) for r in licences.scan_licences(docs, known).collect())
    yes = lambda k: (k, "MIT", None)
    no = lambda k: (k, None, None)
    assert got == multiset([yes(1), yes(2), no(3), yes(4), yes(5), no(6), no(7), no(8), (9, None, "Apache-2.0,MIT"), no(9), yes(None)])
    assert licences.scan_licences(docs.where("false"), known).count() == 0


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licence for r in licences.scan_licences(docs, licences.known_licences(spark)).orderBy("doc_id").collect()]


def test_real_licence_files(spark):
    """Licence files as published packages have them, title and copyright lines included, and all long texts."""
    paths = sorted(Path(__file__).with_name("licences").glob("*.txt"))
    texts = [p.read_text() for p in paths] + [text for name, text in licences.KNOWN if name in licences.LONG and len(text) > 1000]
    names = [p.stem.removesuffix("-2") for p in paths] + [name for name, text in licences.KNOWN if name in licences.LONG and len(text) > 1000]
    assert found(spark, texts) == names and set(licences.LONG) | {"MIT", "ISC", "BSD-3-Clause"} <= set(names)


def test_titles_and_clauses(spark):
    mit, bsd2, bsd3 = licences.SHORT[1][1], licences.BSD.format(third=""), licences.BSD.format(third=licences.BSD_NAMES)
    texts = ["MIT License\n\nCopyright (c) 2024 X\n\n" + mit, "The MIT License (MIT)\n" + mit, bsd2, bsd3, "BSD License\n" + bsd3,
             "Another License\n" + mit, mit + "\nBut not on Sundays.", bsd3.replace("2. ", "* ").replace("1. ", "* ").replace("3. ", "* ")]
    assert found(spark, texts) == ["MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", None, None, "BSD-3-Clause"]


def test_licences_wrapped_otherwise(spark):
    mit, isc, bsd3 = licences.SHORT[1][1], licences.SHORT[0][1], licences.BSD.format(third=licences.BSD_NAMES)
    wrapped = lambda text, width: "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))
    own = "Copyright (c) 2024 Jane Doe"
    one_line = [" ".join(f"{title} {own} {text}".split()) for title, text in (("", mit), ("MIT License", mit), ("", isc), ("", bsd3))]
    one_line.append(" ".join(f"{own}. All rights reserved. {bsd3}".split()))
    broken = [mit.replace("COPYRIGHT HOLDERS", to) for to in ("COPYRIGHT\nHOLDERS", "copyright  holders", "copyright\r\n   holders")]
    narrow = [wrapped(f"MIT License\n\n{own}\n\n{mit}", width) for width in (28, 33, 60, 200)]
    longer = [(name, wrapped(text, 50)) for name, text in licences.KNOWN if name in licences.LONG and len(text) > 1000]
    assert found(spark, [*one_line, *broken, *narrow]) == ["MIT", "MIT", "ISC", "BSD-3-Clause", "BSD-3-Clause", *["MIT"] * 7]
    assert found(spark, [text for _, text in longer]) == [name for name, _ in longer]


def test_only_copyright_statements_are_dropped(spark):
    mit = licences.SHORT[1][1]
    prose = "Copyright 1976 " + "was a year of many words " * 10
    others = ["Copyright (c) 2010-2024 A and B\n(c) by C, 2011\nCopyright D 2012. All rights reserved.\n" + mit, "Copyright (c) Meta Platforms, Inc. and affiliates.\n\n" + mit]
    assert found(spark, [f"{prose}\n{mit}", f"Copyright law has rules. In 1976 came more of them, said the court.\n{mit}", *others]) == [None, None, "MIT", "MIT"]
    empty = spark.range(1).select(F.md5(licences.canonical(F.lit(prose))) == F.md5(F.lit("")))
    assert not empty.first()[0]


def test_wrapped_licences_as_sql(spark, tmp_path):
    """Known texts at several widths, with statements, titles and prose around them, and statements alone."""
    wrapped = lambda text, width: "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))
    own = ["", "Copyright (c) 2024 Jane Doe\n", "Copyright 2020 A B. All rights reserved.\n\n", "MIT License (c) by C, 2011 ", "In prose: ", "Copyright (c) 2024 Jane Doe "]
    texts = [before + wrapped(text, width) for _, text in licences.KNOWN[:40] for width in (31, 80, 5000) for before in own]
    texts += [text for _, text in licences.KNOWN] + [None, "", "© 1999 me", "All rights reserved", "neither the name of X nor the names of its contributors", "non-\ncommercial copyright  holders"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op7_licences(spark, str(tmp_path))
    assert got.where("licence is not null").count() > len(texts) / 2
    assert difference(got, con, oracles.LICENCES) is None


def test_same_rows_as_sql(spark, sf):
    con = connect(sf)
    for name, sql in oracles.ORACLES.items():
        assert difference(queries.QUERIES[name](spark, sf), con, sql) is None, name


def test_plans_run_no_python(spark, sf):
    for name in ("op3_quotation_linking", "op7_licences"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), plan


def plain_passages(text):
    """Levels and bodies of passages, line by line."""
    out, before = [], (-1, "")
    for raw in (text or "").split("\n"):
        lead = re.match(r"[\s>]*", raw, re.ASCII).group()
        line = (lead.count(">"), " ".join(re.split(r"[ \t\n\x0b\f\r]+", raw[len(lead):].lower())).strip(" "))
        if line[1] and before[1] and line[0] == before[0]:
            out[-1] = (line[0], f"{out[-1][1]} {line[1]}")
        elif line[1]:
            out.append(line)
        before = line
    return out


def test_passages_as_line_by_line(spark):
    pick = random.Random(5)
    texts = ["\n".join(pick.choice(["", " ", "> ", ">", ">>", " > > ", "\t"]) + pick.choice(["", "", "a", "B  c", "d > e", "\r"]) for _ in range(pick.randrange(30))) for _ in range(300)]
    texts += [None, "", "\n", ">", "a", "> a\n> b\nc\n\nd\n>> e\n> f"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", quotes._passages(F.col("text")).alias("p"))
    assert {r.i: [tuple(x) for x in r.p] for r in df.collect()} == {i: plain_passages(t) for i, t in enumerate(texts)}


def test_very_long_messages(spark):
    """A pasted log of 100,000 paragraphs, one paragraph of 100,000 lines, one line of 100,000 markers, many blank lines."""
    n = 100_000
    log, block = "\n\n".join(f"entry {i}" for i in range(n)), "\n".join(f"part {i}" for i in range(n))
    mark = lambda t: "\n".join(f"> {x}" for x in t.split("\n"))
    rows = [(1, 0, log), (1, 1, mark(log)), (2, 0, block), (2, 1, mark(block) + "\n\nyes"), (3, 0, ">" * n + " deep"), (4, 0, "a" + "\n" * n + " " * n + "b")]
    start = time.monotonic()
    got = {(r.conv_id, r.turn): r for r in linked(spark, rows).collect()}
    assert time.monotonic() - start < 60
    assert [(r.n_quoted, r.n_linked, r.depth) for _, r in sorted(got.items())] == [(0, 0, 0), (n, n, 1), (0, 0, 0), (1, 1, 1), (1, 0, 0), (0, 0, 0)]
    assert got[2, 1].own_text == "yes" and got[1, 1].own_text == "" and len(got[4, 0].own_text) == 2 * n + 2


def test_edges(spark, edge, none):
    mail = lambda df: quotes.reply_conversations(df.withColumn("found", F.lit(1)), "doc_id", "n_chars", "text")
    got = mail(edge)
    assert got.count() == edge.count() and got.where("own_text is null or depth is null or thread_conv is null and conv_id is not null").count() == 0
    assert mail(none).count() == 0 and mail(none).columns == got.columns


def test_hot_keys(spark):
    """A passage that all quote, a message that all answer and a name that a third of the rows share."""
    rows = [(0, 0, "Hello all."), *[(i, 1, "> hello all.\n\nanswer") for i in range(1, 4000)], *[(0, 1, "> Hello all.") for _ in range(2000)], *[(None, None, "nobody") for _ in range(2000)]]
    got = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(7)
    counts = quotes.reply_conversations(got).groupBy("parent_conv", "thread_conv", "depth", "n_linked").count().collect()
    assert multiset(counts) == multiset([(None, 0, 0, 0, 1), (0, 0, 1, 1, 3999), (0, 0, 1, 2000, 2000), (None, None, 0, 0, 2000)])


def test_nobody_links_to_messages_without_a_name(spark):
    rows = [(None, 0, "shared words"), (1, None, "shared words"), (2, 0, "shared words"), (3, 0, "> shared words")]
    got = {r.conv_id: r for r in linked(spark, rows).collect()}
    assert (got[3].parent_conv, got[3].parent_turn, got[3].depth) == (2, 0, 1)


def test_repeated_turns_as_sql(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    some = turns.where("conv_id % 3 = 0")
    turns.unionByName(some).unionByName(some.withColumn("text", F.concat(F.lit("other "), "text"))).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op3_quotation_linking(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got.count() == turns.count() + 2 * some.count()
    assert difference(got, con, oracles.QUOTES) is None

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from tesselith.llm import pagespam as S

HEAD = "commit 0123456789abcdef\nAuthor: A B <a.b@c.test>\nDate:   Mon Jan 1 00:00:00 2024 +0000\n\n    docs\n\n\ndiff --git a/x.md b/x.md\nindex 1..2 100644\n--- a/x.md\n+++ b/x.md\n@@ -1,0 +1,9 @@\n"


def commit(*lines):
    return HEAD + "".join(f"+{x}\n" for x in lines)


def share(text):
    return float(S.shares(pa.array([text], pa.large_string()))["share"][0])


SPAM = {
    "repeated": ["cheap red shoes cheap red shoes best blue hats cheap red shoes"] * 4,
    "links": [f"https://shop{i}.example/go/{i}a" for i in range(9)],
    "anchors": [f'<a href="https://h{i}.test/red-shoes">red shoes</a>' for i in range(9)],
    "markdown": [f"- [best hats](https://h{i}.test/best-hats)" for i in range(9)],
    "table": [f"| red shoes Townville | ${i}.99 | h{i}.test/red-shoes |" for i in range(9)],
    "call": [f"red shoes call +00 {i}00 1234 best hats, mail sales@h{i}.test, visit h{i}.example" for i in range(9)],
    "disguised": ["ch3@p r3d sh03s c h e a p   r e d   s h o e s BUY RED SHOES cheap.red.shoes"] * 5,
    "tags": ["Tags: red shoes, cheap hats, red shoes, hats, cheap, red shoes, hats, cheap"] * 3,
    "hashes": ["#redshoes #besthats #cheapshoes #hatsTownville #redshoes"] * 3,
    "meta": ['<meta name="keywords" content="red shoes, best hats, cheap shoes, red shoes, best hats, cheap shoes">'] * 2,
}
WORK = {
    "sentences": ["The cache is now read once at start.", "Nothing else should change for people who do not use it."] * 5,
    "code": ["int x = load(y);", "return foo_bar(x);", "if (a) {", "}"] * 5,
    "changelog": [f"* fix cache ([#{i}](https://h.example/pull/{i})), closes [#{i + 1}](https://h.example/issues/{i + 1})" for i in range(9)],
    "moved": [f"http://h.example/a/{i} -> https://h.example/b/{i}" for i in range(9)],
    "sitemap": [f"  <url><loc>https://h.test/docs/{i}</loc></url>" for i in range(9)],
    "annotated": [f"- [Name{i}](https://h{i}.test/x) - The second pass of the nightly run is described here." for i in range(9)],
    "words": ["red shoes", "best hats", "cheap shoes", "blue hats"] * 1,
    "data": ["62,segment,partial,322", "62,segment,partial,322", "14,chunk,remote,279"] * 4,
    "lock": ['    "left-pad": "^1.3.0",', '    "right-pad": "^1.3.1",'] * 5,
    "translations": ['msgid "build token"', 'msgstr "jeton de build"'] * 6,
    "conflicts": ["<<<<<<< HEAD", "=======", ">>>>>>> red-shoes-cheap-hats"] * 3,
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert share(commit(*SPAM[name])) >= S.Rule().share
    hidden = commit("import os", "x = load(1)", *[f"# {x}" for x in SPAM[name]], "return x.y(2)")
    assert share(hidden) >= S.Rule().share


@pytest.mark.parametrize("name", WORK)
def test_work(name):
    assert share(commit(*WORK[name])) < S.Rule().share


def test_only_message_and_added_lines_count():
    spam = SPAM["links"]
    removed = HEAD + "".join(f"-{x}\n {x}\n" for x in spam) + "+int x = load(y);\n"
    assert share(removed) < S.Rule().share
    message = "changeset:   1:ab\nuser:        A <a@b.test>\ndate:        x\nsummary:     " + spam[0] + "\n\n" + "\n".join(spam) + "\n"
    assert share(message) >= S.Rule().share
    doc, lines = S.own_lines(pa.array(["r5 | a | 2024-01-24 | 1 lines\n\nfix it\r\n", HEAD + "+a\n b\n-c\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n+d\n", ""]))
    assert [x for x in zip(doc.tolist(), lines.to_pylist()) if x[1]] == [(0, "fix it"), (1, "    docs"), (1, "a"), (1, "d")]


def test_nulls_empty_long_and_repeated(spark):
    long = commit(*["cheap red shoes cheap red shoes"] * 20_000)
    one = commit("x" * 300_000, "a " * 50_000, "1 " * 50_000, "." * 50_000, "#" * 50_000, "- " * 50_000, "a.b" * 20_000)
    docs = [(1, None), (2, ""), (3, long), (4, one), (None, commit(*SPAM["links"])), (5, commit(*SPAM["links"])), (5, commit(*SPAM["links"])), (6, "\n\n")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as share", "2 as n_chars")
    got = [(r["doc_id"], r["flagged"]) for r in S.page_shapes(df).collect()]
    assert sorted(got, key=str) == sorted([(1, False), (2, False), (3, True), (4, False), (None, True), (5, True), (5, True), (6, False)], key=str)
    assert S.page_shapes(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no test tables")
def test_against_the_raters(spark):
    base = "/root/testdata/sf0.01"
    found = S.page_shapes(spark.read.parquet(f"{base}/documents.parquet")).join(spark.read.parquet(f"{base}/spam_labels.parquet"), "doc_id").collect()
    right = sum(r["flagged"] == bool(r["spam_label"]) for r in found)
    assert right >= 0.95 * len(found)  # raters err, too


PLAIN = {
    "alike": [f"move the {x} into its own module and keep the old {y}" for x, y in (("reader", "name"), ("writer", "tests"), ("parser", "name"), ("cache", "path"))],
    "same": ["fix the build of the parser on linux and mac"] * 4,
    "without stops": ["we read the table once and keep what the first pass found", "the second pass then needs no lock at all", "readers of old files see the same rows as before", "nothing is written until all of them agree"],
    "awesome": [f"- [tool{i}](https://git.host/u{i}/tool{i}) small {w} for parsing and printing of {v} files" for i, (w, v) in enumerate((("library", "date"), ("program", "trace"), ("shell", "mail"), ("server", "map"), ("kit", "font"), ("index", "log")))],
    "files": [f"{a}_{b}.py" for a in ("read", "write", "merge") for b in ("one", "two", "all")] + ["setup.py", "readme.md", "build.rs"],
    "modules": ["import os.path", "os.path", "json.decoder", "from foo.bar import baz"] * 3,
    "thanks": ["Thanks to Anna Berg for the report", "Thanks to Otto Lind for the patch", "thanks also to Eva Holm and Jon Falk"],
    "german": ["die neue Prüfung liest jede Zeile nur einmal", "alte Dateien bleiben dabei wie sie waren", "der Rest der Tests folgt mit dem nächsten Schritt"],
}
PROMOTION = {
    **{f"hosts{e}": [f"shop{i}{e}" for i in range(9)] for e in (".ru", ".de", ".io", ".test", ".co.uk")},
    **{f"paths{e}": [f"best-hats{i}{e}/red-shoes" for i in range(9)] for e in (".ru", ".de", ".io")},
    "cells": [f"| red shoes Townville | hats{i}.ru |" for i in range(9)],
    "visit": [f"red shoes and hats call +00 {i}00 1234 mail us@h{i}.ru, visit h{i}.de" for i in range(9)],
    "labels": [f"* Best {a} {b} >> https://h{i}.io/best-{a}-{b}".lower() for i, (a, b) in enumerate((a, b) for a in ("Red", "Blue", "Warm") for b in ("Shoes", "Hats", "Gloves"))],
    "without repeats": ["cheap red shoes, best blue hats, discount gold watches, luxury leather bags, winter boots", "online poker rooms, fast cash advance, natural skin cream, seo backlinks, roof repair", "video editor, web hosting, thesis help, hair serum, movie streams"],
    "many links": [f"http://a{i}.ru/x http://b{i}.de/y http://c{i}.io/z" for i in range(5)],
    "stop": ["buy cheap shoes cheap shoes cheap shoes now cheap shoes."] * 3,
}


@pytest.mark.parametrize("name", PLAIN)
def test_plain_messages_and_lists_of_work(name):
    message = HEAD.replace("    docs\n", "".join(f"    {x}\n" for x in PLAIN[name]))
    assert share(message) < S.Rule().share and share(commit(*PLAIN[name])) < S.Rule().share


@pytest.mark.parametrize("name", PROMOTION)
def test_promotion_of_any_host_and_wording(name):
    assert share(commit(*PROMOTION[name])) >= S.Rule().share


def test_long_tokens_take_no_time():
    """In a process of its own: a pattern that tries every split of the digits would never come back."""
    lines = [f"Revert {token}{end} it broke the build" for token in ("7" * 33 + "abcdef0", "0123456789" * 6 + "abcd", "a1" * 50_000, "a." * 50_000, "a " * 50_000) for end in (",", "-", "_")]
    code = "import sys, pyarrow as pa; from tesselith.llm import pagespam as S; assert (S.shares(pa.array(sys.stdin.read().split('\\n')))['n_chars'] > 0).all()"
    subprocess.run([sys.executable, "-c", code], input="\n".join(lines), text=True, check=True, timeout=30, cwd=Path(__file__).parents[2])
    assert [S._plain(w) for w in ("v14gra", "c@sh", "Viagra")] == ["viagra", "cash", "viagra"]

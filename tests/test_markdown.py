import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.functions import markdown as M

PAGE = """---
title: "A page"
tags: [one/two, 'three']
resource:
  - src/a.md
  - b
aliases: Ann
description: Short text
---
Lead text.

# Title

First sentence here. Second one.

## Alpha
see [[x/y|label]] and [[z]]
```sh
## not a heading [[code]]
```

## Beta
- [[gone]]
- [[z]] stays
"""


def test_frontmatter():
    assert M.tags_of(PAGE) == ["one/two", "three"] and M.resources_of(PAGE) == ["src/a.md", "b"]
    assert M.aliases_of(PAGE) == ["Ann"] and M.description_of(PAGE) == "Short text"
    assert M.split_frontmatter("--- no")[0] == "" and M.frontmatter_fields("plain") == {}
    changed = M.set_field(PAGE, "resource", ["c"])
    assert M.resources_of(changed) == ["c"] and M.aliases_of(changed) == ["Ann"] and M.tags_of(changed) == ["one/two", "three"]
    assert M.resources_of(M.drop_field(PAGE, "resource")) == [] and M.ensure_field(PAGE, "description", "x") == PAGE
    assert M.description_of(M.ensure_field("body", "description", "x y")) == "x y"
    fixed, warnings = M.kept_entries(PAGE, "resource", {"b"})
    assert M.resources_of(fixed) == ["b"] and warnings == ["resource: removed src/a.md"]


def test_sections_and_links():
    heads = [s["heading"] for s in M.h2_sections(PAGE)]
    assert heads == ["", "Alpha", "Beta"] and "".join(s["text"] for s in M.h2_sections(PAGE)) == PAGE
    assert M.answer_links(M.split_frontmatter(PAGE)[1]) == ["x/y", "z", "gone"]
    assert [v["kind"] for v in M.link_violations(PAGE)] == ["alias"]
    assert "[[y]]" in M.fix_links(PAGE)
    clean = M.strip_dead_links(PAGE, {"z", "x/y", "code"})
    assert "gone" not in clean and "- [[z]] stays" in clean
    assert M.annotate_broken("[[a]] `[[a]]`", {"a"}) == "[[a]] (missing) `[[a]]`"
    assert M.replace_link("[[a|b]] [[a]]", "a", "c") == "[[c|b]] [[c]]"
    assert M.to_markdown_links("[[z|Zed]] [[q]]", {"z": "t/z.md"}) == ("[Zed](t/z.md) q", ["q"])
    assert M.section_links(PAGE, {"beta"}) == ["gone", "z"] and "Beta" not in M.remove_sections(PAGE, {"beta"})
    assert M.links(M.add_links("# T\n", "Related", ["a", "a"])) == ["a"] and M.add_links(PAGE, "Beta", ["z"]) == PAGE
    assert M.title_of(PAGE, "x") == "Title" and M.fallback_description(PAGE, "kind") == "Title. Lead text.. kind"


def test_patches():
    page = "lead\n\n## A\none\n"
    assert M.apply_patch(page, [{"action": "append", "heading": "A", "body": "two"}])[0] == "lead\n\n## A\none\ntwo\n"
    assert M.apply_patch(page, [{"action": "add", "heading": "B", "body": "x"}])[0].endswith("## B\nx\n")
    assert M.apply_patch(page, [{"action": "replace", "heading": "C", "body": "x"}]) == (page, ["unknown section: C"])
    assert M.apply_patch(page, [], "other") == (page, ["stale page"])
    assert M.apply_patch(page, [{"action": "replace", "heading": "A", "body": "x", "hash": "old"}])[1] == ["stale section: A"]
    assert "## B" in M.merge_sections(page, "## a\nx\n\n## B\ny\n") and M.merge_sections(page, "## A\nz") == page


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# h", "## s", "text words here", "", "```", "- item", "x" * 40]), max_size=40), st.integers(20, 120), st.integers(0, 2))
def test_chunks_cover_every_line(lines, budget, overlap):
    text = "\n".join(lines)
    chunks = M.chunk_source(text, budget, overlap=overlap)
    assert M.uncovered_lines(text, chunks) == []
    assert all(len(c["text"]) <= budget or c["start"] == c["end"] for c in chunks)


def test_units_and_windows():
    units = M.split_units("## A\n" + "a" * 300 + "\n## B\nshort\n## Related\n[[x]]\n", 50, 100, 20)
    assert {u["heading"] for u in units} == {"A"} and all(len(u["text"]) <= 100 for u in units)
    assert len(M.split_units("## A\n" + "a" * 900, 50, 100, 20, cap=3)) == 3


def test_technical_units():
    text = "Run `ls -l` at http://a.io/x, host 10.0.0.1:80, path /etc/hosts, mode=fast --force 42 MB\n```\ncode line\n```\n"
    units = {(u["kind"], u["value"]) for u in M.technical_units(text)}
    assert units == {("fenced", "code line"), ("inline", "ls -l"), ("url", "http://a.io/x"), ("ipv4", "10.0.0.1:80"), ("path", "/etc/hosts"), ("assignment", "mode=fast"), ("flag", "--force"), ("number", "42 MB")}
    missing = M.unsupported_units("see `rm` and 42, 7", ["has 42 items, 17"])
    assert [u["value"] for u in missing] == ["rm", "7"] and M.sanitise_answer("see `rm` and 42\n- `rm`", missing) == "see and 42"


def test_rewrites_and_json():
    lost = M.missing_tokens("The Foo has 12 parts\nNASA said", "The foos has parts")
    assert {m["token"] for m in lost} == {"12", "NASA"} and M.append_missing("x", lost).count("\n") == 4
    assert M.looks_truncated('{"a": [1') and M.looks_truncated('{"a": "b') and not M.looks_truncated('{"a": "]"}')
    assert M.tolerant_json('text {bad} {"b": 1, "a": 2} tail') == '{"a": 2, "b": 1}' and M.tolerant_json("none") is None
    assert M.render_template("{{a}} {{b}}", {"a": "x"}) == "x {{b}}"


def test_columns_hold_few_rows_as_python_objects(spark):
    """A batch of many texts is not turned into Python objects as a whole."""
    taken = []

    class Watched:
        def __len__(self):
            return 1000

        def slice(self, at, n):
            taken.append(n)
            return pa.array([f"t{i}" if i % 7 else None for i in range(at, min(1000, at + n))])

    assert M._by_slices(lambda t: t + "!", pa.string(), Watched()).to_pylist() == [f"t{i}!" if i % 7 else "!" for i in range(1000)]
    assert max(taken) <= 64
    texts = spark.createDataFrame([("[[a]]",), (None,), ("",)], "t string")
    assert [r.l for r in texts.select(M.column(lambda c: M.links(c), "array<string>")(F.col("t")).alias("l")).collect()] == [["a"], [], []]

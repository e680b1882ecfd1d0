"""Chunkers against plain specifications, properties and golden snippets."""

import random

import pytest

from corvane.operators import chunk
from corvane.operators.scanner import Unbalanced, declarations


def spec_lines(text, max_tokens, overlap):
    """The rules word by word: grow a window line by line, step back by the overlap."""
    rows, out, start = text.split("\n"), [], 0
    while start < len(rows):
        end, body = start, ""
        while end < len(rows) and (not body or -(-(len(body) + len(rows[end]) + 1) // 4) <= max_tokens):
            body += rows[end] + "\n"
            end += 1
        if body.strip():
            out.append((body.rstrip(), start + 1, end))
        if end >= len(rows):
            break
        start = max(start + 1, end - overlap)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_by_lines_matches_specification(seed):
    r = random.Random(seed)
    text = "\n".join("x" * r.choice([0, 0, 3, 17, 60, 200]) for _ in range(r.randrange(1, 60))) + r.choice(["", "\n", "\n\n"])
    limit, overlap = r.choice([5, 20, 50]), r.choice([0, 1, 5])
    got = [(p.text, p.start, p.end) for p in chunk.by_lines(text, limit, overlap)]
    assert got == spec_lines(text, limit, overlap)
    covered = {n for _, s, e in got for n in range(s, e + 1)}
    assert {k + 1 for k, row in enumerate(text.split("\n")) if row.strip()} <= covered
    starts = [s for _, s, _ in got]
    assert starts == sorted(set(starts))
    assert all(len(t) <= 4 * limit or s == e for t, s, e in got)


def test_long_line_empty_text_and_astral_characters():
    assert [(p.start, p.end) for p in chunk.by_lines("y" * 4000 + "\nz", 800, 5)] == [(1, 1), (2, 2)]
    assert chunk.fallback("") == [] and chunk.fallback(" \n\t\n") == []
    assert chunk.units("a\U0001f600") == 3


def test_hash_id():
    assert chunk.hash_id("src/a.ts", 1) == "00lny57y"


def test_markdown_sections_and_fallback():
    body = "word " * 40
    text = f"pre {body}\n# One\n{body}\n#### not\n## Two\nshort\n```\n# in a fence {body}\n```"
    got = [(p.symbol, p.start, p.end, p.kind) for p in chunk.markdown(text)]
    assert got == [("intro", 1, 1, "section"), ("One", 2, 4, "section"), (f"in a fence {body}", 8, 9, "section")]
    assert [p.kind for p in chunk.markdown("# A\nshort")] == ["block"]


CODE = '''import { a } from "./a";

/** Doc. */
export function one(x: number): string {
  return `a ${x ? `b ${"}"}` : /[/}]/.test("x")} c`;
}

export default class Two<T> extends Base {
  run() { return { a: 1 }; }
}
interface Three { a: string }
export type Four = { a: string } | "x";
export const five = async () => {
  await one(5);
};
const six = 1;
enum Seven { A, B }
function* eight() {}
'''


def test_code_declarations():
    got = [(d.kind, d.name, d.start, d.end, d.exported) for d in declarations(CODE)]
    assert got == [
        ("function", "one", 4, 6, True), ("class", "Two", 8, 10, True), ("interface", "Three", 11, 11, False), ("type", "Four", 12, 12, True),
        ("variable", "five", 13, 15, True), ("variable", "six", 16, 16, False), ("function", "eight", 18, 18, False)]
    pieces = chunk.code(CODE)
    assert [p.symbol for p in pieces] == ["one", "Two", "Three", "Four", "five", "eight"]
    assert pieces[0].text.startswith("/** Doc. */")


def test_code_falls_back():
    assert [p.kind for p in chunk.code("enum A { B }")] == ["block"]
    assert [p.kind for p in chunk.code("function a( {")] == ["block"]
    with pytest.raises(Unbalanced):
        declarations("const a = 'x")


def test_header_and_large_nodes():
    head = "\n".join(f"import x{k} from 'module-{k}';" for k in range(20))
    big = "export class Big {\n" + "\n".join(f"  method{k}() {{ return {k}; }}" for k in range(200)) + "\n}"
    got = chunk.code(f"{head}\n{big}\n", 100, 2)
    assert (got[0].kind, got[0].symbol, got[0].start, got[0].end) == ("imports", "file-header", 1, 20)
    assert {p.symbol for p in got[1:]} == {"Big"} and got[1].start == 21 and got[-1].end == 222


def test_chunk_files_and_udtf(spark):
    from corvane.schema import FILES

    rows = [("a.ts", "typescript", "root", "m", CODE), ("b.md", "markdown", "root", "m", "# T\n" + "w " * 80), ("c.txt", "text", "root", "m", None), ("d.txt", "text", "root", "m", "x")]
    got = chunk.chunk_files(spark.createDataFrame(rows, FILES)).collect()
    assert [r["symbol_name"] for r in got if r["file_path"] == "b.md"] == ["T"]
    assert sorted({r["file_path"] for r in got}) == ["a.ts", "b.md", "d.txt"]
    assert {r["id"] for r in got if r["file_path"] == "d.txt"} == {chunk.hash_id("d.txt", 1)}
    chunk.register(spark)
    spark.createDataFrame(rows, FILES).createOrReplaceTempView("source_files")
    assert spark.sql("SELECT count(*) AS n FROM source_files, LATERAL chunk_text(content, language)").first()["n"] == len(got)

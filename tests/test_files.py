"""Raw files from a folder, their conversion, and the imports between code files."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import code_graph, converting
from tessera.sources import raw

FILES = {
    "a.md": b"\xef\xbb\xbftext\n##  Sub\n#  Title here  \n# Second\n", "notes/b c+1.txt": "été\n\n  \n".encode(), "log/x.LOG": b" \n", "sub/main.c": b'#include <stdio.h>\n #include "own.h"\nstatic int\nrun(int a) {\n  while (a) {\n  }\n}\nint x;\n',
    "sub/index.ts": b"import { a,\n b } from './util';\nexport * from \"./util\"\nconst c = require('../lib')\n", "sub/util.mts": b"export const a = `x`;\n", "lib/index.js": b"\n", "lib.tsx": b"import type { Q } from '.'", "bad.txt": b"\xff\xfe", "doc.pdf": b"%PDF", "node_modules/z.js": b"x",
    "what.bin": b"1", "nothing": b"1", "ticks.js": b"a = ```` 1", "deep/dist/q.md": b"x",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("raw files")
    for name, data in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(data)
    return raw.read(spark, str(base))


def test_folder_is_read_and_sorted_out(spark, files):
    assert {r["path"] for r in files.collect()} == set(FILES)
    found = {r["path"]: (r["kind"], r["skipped"]) for r in raw.discover(files, documents=False).collect()}
    assert set(FILES) - set(found) == {"node_modules/z.js", "deep/dist/q.md"}
    assert {p: s for p, (_, s) in found.items() if s} == {"doc.pdf": "documents are left out", "what.bin": "unsupported extension bin", "nothing": "unsupported extension none"}
    hidden = spark.createDataFrame([(".a/b.md",), ("a/.b.md",), ("dist",), ("a.git/b.md",)], "path string")
    assert {r["path"] for r in raw.discover(hidden).where("skipped is null").collect()} == {"a.git/b.md"}
    assert {r["path"] for r in raw.discover(hidden, hidden=True).where("skipped is null").collect()} == {"a.git/b.md", ".a/b.md", "a/.b.md"}


def test_conversion(files):
    found = {r["path"]: r for r in converting.converted(raw.discover(files).where("skipped is null")).collect()}
    assert found["a.md"]["markdown"] == "text\n##  Sub\n#  Title here  \n# Second\n" and found["a.md"]["title"] == "Title here" and found["a.md"]["line_count"] is None
    assert found["notes/b c+1.txt"]["markdown"] == "# b c+1\n\nété\n" and found["notes/b c+1.txt"]["line_count"] == 1 and found["notes/b c+1.txt"]["source_subtype"] is None
    assert (found["log/x.LOG"]["markdown"], found["log/x.LOG"]["line_count"], found["log/x.LOG"]["source_subtype"]) == ("# x\n\n\n", 0, "log")
    c = found["sub/main.c"]
    assert (c["includes"], c["functions"], c["imports"], c["source_subtype"], c["line_count"]) == (["stdio.h", "own.h"], ["run"], [], "c", 8)
    assert c["markdown"].startswith("# sub/main.c\n\n## Code Metadata\n\n- Language: c\n- Lines: 8\n- Includes:\n  - stdio.h\n  - own.h\n- Functions:\n  - run\n\n## Source\n\n```c\n#include") and c["markdown"].endswith("int x;\n```\n")
    ts = found["sub/index.ts"]
    assert (ts["imports"], ts["export_count"], ts["target"]) == (["./util", "../lib"], 1, "sub/index.ts.md")
    assert "\n`````js\n" in found["ticks.js"]["markdown"]
    assert (found["bad.txt"]["error"], found["bad.txt"]["markdown"]) == ("Unreadable UTF-8 source: bad.txt", None)
    assert found["doc.pdf"]["error"] == "No converter available for .pdf in builtin mode" and found["doc.pdf"]["raw_hash"].startswith("sha256:")


def test_imports(spark, files):
    code = files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    stats = {r["path"]: (r["extension"], r["line_count"], r["import_count"], r["export_count"]) for r in code_graph.code_files(code).collect()}
    assert stats["sub/index.ts"] == (".ts", 5, 3, 1) and stats["lib/index.js"] == (".js", 2, 0, 0) and len(stats) == 5
    found = sorted(tuple(r) for r in code_graph.code_imports(code).collect())
    # of lib.tsx and lib/index.js the file comes first; one specifier written twice is there twice; '.' is no file and has no index
    assert found == [("sub/index.ts", "lib.tsx", "../lib"), ("sub/index.ts", "sub/util.mts", "./util"), ("sub/index.ts", "sub/util.mts", "./util")]


@pytest.mark.parametrize("path, want", [("a/./b/../c.ts", "a/c.ts"), ("a//b", "a/b"), ("../x", "../x"), ("a/../../x", "../x"), ("a/..", ""), ("../../x/..", "../..")])
def test_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(code_graph.normalized(F.col("p"))).first()[0] == want

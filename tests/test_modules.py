"""Imports of TypeScript sources: the files that they name, and what barrels hand on."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import linking
from graphloom.sources import frontends, modules

WORKSPACE = {
    "package.json": '{"name":"mono"}',
    "packages/api/package.json": '{"name":"@co/api","exports":{".":{"types":"./dist/index.d.ts","import":{"default":"./dist/index.mjs"}},"./net/http":"./dist/net/http/index.mjs","./kit/*":["./lib/kit/*.js"],"./z*":"./nowhere/*"}}',
    "packages/api/src/index.ts": "export const up = 1;\n",
    "packages/api/src/net/http/index.ts": "export const get = 2;\n",
    "packages/api/src/kit/a.ts": "export const a = 3;\n",
    "packages/api/src/deep/other.ts": "export const other = 4;\n",
    "packages/api/old/index.ts": "export const old = 5;\n",
    "packages/plain/package.json": '{"name":"plain","main":"build/start.js"}',
    "packages/plain/src/start.ts": "export const start = 6;\n",
    "packages/second/package.json": '{"name":"plain"}',
    "packages/second/index.ts": "export const second = 7;\n",
}


def resolve(spark, tree):
    files = spark.createDataFrame(list(tree.items()), "path string, text string")
    sources = files.where(F.col("path").rlike(r"\.[cm]?[jt]sx?$"))
    found = modules.resolved(sources.select("path"), modules.specifiers(sources), modules.configs(files), modules.packages(files))
    return {(r.path, r.spec): r.file for r in found.collect()}, {tuple(r) for r in modules.resolve(files, sources).collect()}


@pytest.mark.parametrize(
    ("spec", "file"),
    [
        ("@co/api", "packages/api/src/index.ts"),
        ("@co/api/net/http", "packages/api/src/net/http/index.ts"),
        ("@co/api/kit/a", "packages/api/src/kit/a.ts"),
        ("@co/api/deep/other", "packages/api/src/deep/other.ts"),
        ("@co/api/old", "packages/api/old/index.ts"),
        ("@co/apiary", None),
        ("plain", "packages/plain/src/start.ts"),
        ("left-pad", None),
    ],
)
def test_packages_of_the_project(spark, spec, file):
    found, _ = resolve(spark, WORKSPACE | {"app/main.ts": f"import {{ x }} from '{spec}';\n"})
    assert found.get(("app/main.ts", spec)) == file


def test_relative_paths_extensions_and_indexes(spark):
    tree = {"src/a.tsx": "", "src/b/index.mts": "", "src/c.ts": "", "src/c.js": "", "src/d.ts": "", "src/e.test.ts": "", "top.ts": ""}
    lines = ["./a", "./b", "./c", "./c.js", "./d.js", "./e.test", "../top", "./missing", "./b/../a", "..//top.js", ". ", "./dir"]
    found, _ = resolve(spark, tree | {"src/main.ts": "".join(f"import '{x}'\n" for x in lines)})
    want = {"./a": "src/a.tsx", "./b": "src/b/index.mts", "./c": "src/c.ts", "./c.js": "src/c.js", "./d.js": "src/d.ts", "./e.test": "src/e.test.ts", "../top": "top.ts", "./b/../a": "src/a.tsx", "..//top.js": "top.ts"}
    assert {s: f for (_, s), f in found.items()} == want


def test_path_patterns_by_longest_fixed_part(spark):
    config = """{ // with comments, and "quotes"
      "compilerOptions": { /* , } */ "baseUrl": "./", "paths": { "~/*": ["gen/*", "src/*"], "~/lib/*": ["src/special/*"], "~/lib/*.css": ["src/*"], "exact": ["src/one", "src/two"], "//x": ["src/two"], }, }, }"""
    inner = '{"compilerOptions":{"paths":{"#/*":["./*"]}}}'
    tree = {"tsconfig.json": config, "src/a.ts": "", "src/special/b.ts": "", "src/two.ts": "", "inner/tsconfig.json": inner, "inner/c.ts": "", "broken/tsconfig.json": "{", "only/tsconfig.json": '{"compilerOptions":{"strict":true}}'}
    asked = "import x from '~/a'\nimport '~/lib/b'\nimport 'exact';\nimport '//x'\nimport 'src/a.js'\nimport '#/c'\nimport '~/lib/c.css'\n"
    found, _ = resolve(spark, tree | {"app/main.ts": asked, "inner/deep/main.ts": asked, "broken/main.ts": asked, "only/main.ts": asked})
    outer = {"~/a": "src/a.ts", "~/lib/b": "src/special/b.ts", "exact": "src/two.ts", "//x": "src/two.ts", "src/a.js": "src/a.ts"}
    for path in ("app/main.ts", "broken/main.ts", "only/main.ts"):
        assert {s: f for (p, s), f in found.items() if p == path} == outer
    # the nearest config alone counts
    assert {s: f for (p, s), f in found.items() if p == "inner/deep/main.ts"} == {"#/c": "inner/c.ts"}


def test_forms_of_imports(spark):
    text = "import a, {\n  b,\n  c as d } from './x'\nimport type { T } from \"./t\";\nexport * from './y'\nexport { e as f } from `./z`;\nimport './side'\nexport const g = 'from';\nexport function h() { return './no'; }\nimport * as n from './y'\n"
    rows = modules.specifiers(spark.createDataFrame([("p.ts", text), ("none.ts", None)], "path string, text string"))
    assert {(r.spec, r.handed) for r in rows.collect()} == {("./x", False), ("./t", False), ("./y", True), ("./z", True), ("./side", False)}


def test_barrels_hand_on_around_cycles(spark):
    tree = {"lib/index.ts": "export * from './impl';\n", "lib/impl/index.ts": "export { a } from './a';\nexport * from '../index';\n", "lib/impl/a.ts": "import './b'\n", "lib/impl/b.ts": "", "app/main.ts": "import { a } from '../lib';\n"}
    _, reached = resolve(spark, tree)
    assert {f for p, f in reached if p == "app/main.ts"} == {"lib/index.ts", "lib/impl/index.ts", "lib/impl/a.ts"}
    assert {f for p, f in reached if p == "lib/index.ts"} == {"lib/index.ts", "lib/impl/index.ts", "lib/impl/a.ts"}


def test_a_long_chain_of_barrels(spark):
    tree = {f"b{i}.ts": f"export * from './b{i + 1}'\n" for i in range(12)} | {"b12.ts": "", "m.ts": "import './b0'\n"}
    _, reached = resolve(spark, tree)
    assert {f for p, f in reached if p == "m.ts"} == {f"b{i}.ts" for i in range(13)}


def test_projects_link_through_barrels_and_aliases(spark):
    tree = {
        "package.json": '{"name":"app"}', "tsconfig.json": '{"compilerOptions":{"paths":{"~/*":["src/*"],}}}', "src/lib/index.ts": "export * from './foo';\n",
        "src/lib/foo.ts": "export function foo() { return 1; }\n", "src/main/run.ts": "import { foo } from '~/lib';\nexport function run() { return foo(); }\n", "src/main/run.spec.ts": "import { foo } from './nothing';\nfoo();\n", "src/x.d.ts": "export function foo(): number;\n",
    }
    g = frontends.load(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in tree.items()], "path string, content binary"), "m")
    assert {(r.src, r.dst) for r in g.edges.collect()} == {("app/src/main.run", "app/src/lib.foo")}
    assert {(r.src, r.dst) for r in g.imports.collect()} == {("app/src/main", "app/src/lib")}


def test_names_link_as_by_all_pairs(spark):
    import random

    rng = random.Random(4)
    decls = [(f"d{i}", f"n{i % 7}", f"p{i % 9 % 4}", f"f{i % 9}", rng.random() < 0.6, rng.random() < 0.3) for i in range(120)]
    own = {d: (n, p, f, m) for d, n, p, f, _, m in decls}
    visible = [(f"f{i}", f"p{rng.randrange(4)}") for i in range(9)]
    refs = [(d, own[d][0], own[d][3], own[d][2], own[d][1], f"n{rng.randrange(8)}", k) for d in own for k in ("caller", "user")]
    want = set()
    for src, _, _, path, pkg, short, kind in refs:
        c = [x for x in decls if x[1] == short and x[0] != src and (x[2] == pkg or (x[4] and (path, x[2]) in visible))]
        c = [x for x in c if not x[5] or len(c) == 1]
        near = [x for x in c if x[3] == path]
        want |= {(src, x[0], kind) for x in near or c}
    got = linking.named(spark.createDataFrame(refs, "src string, own string, own_member boolean, path string, pkg string, short string, kind string"), spark.createDataFrame(decls, "dst string, short string, to string, at string, exported boolean, member boolean"), spark.createDataFrame(visible, "path string, to string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)

"""Findings kept up to date from changed files alone.

A batch of changed files (path, text; a null text is a file that is gone) is parsed, and nothing else is. Its declarations replace those
of its files; references are linked again in files that changed, that see a package whose names changed and use one of these names, or
that import a module which came or went; declarations are judged again in packages that have such a file, or an end of a link that came or went. The two rules about packages
are sums over all links and are made again from those.

Every table is a folder a batch, with an index of the keys (files or packages) that the batch wrote; a key's rows are those
of its last batch. A batch that is run again, after a kill at any place, reads only those before it and writes its own folders anew, so
results are the same. `compact` makes one batch of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import linking, smells
from graphloom.plans.checkpoints import stored
from graphloom.sources import frontends, lexical, python_code
from graphloom.sources.binding import Graph
from graphloom.streaming.live import FingerprintSource, watched

_FINDING = ", ".join(f"{c} {'bigint' if c in ('severity', 'line', 'measure', 'limit_value') else 'string'}" for c in smells.COLUMNS)
#: Tables, and the index by which the last batch of a key is told: what a batch has parsed, linked and judged.
TABLES = {
    "rows": (python_code.DECLS, "paths", "path"),
    "links": ("path string, src string, dst string, kind string, n bigint", "linked", "path"),
    "found": (_FINDING, "judged", "package"),
}
INDEXES = {"paths": "path string, alive boolean, whole bigint, generated boolean, size bigint, mtime bigint", "linked": "path string", "judged": "package string"}
ACROSS = ("unstable_dep", "untested_package")
#: What a declaration is called within a batch's tables: its file and place in it, which no other file's change alters.
KEY = "concat(path, ':', ord)"


class Incremental:
    """The findings of one root in one language (python or rust), in a shared folder `at`."""

    def __init__(self, spark: SparkSession, at: str, module: str, lang: str = "python") -> None:
        self.spark, self.at, self.module, self.lang = spark, at, module, lang

    def _write(self, name: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.at}/{name}/batch={batch}")

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        """All rows of batches before one; none where no batch was written yet."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.at}/{name}").where(F.col("batch") < before)

    def _index(self, name: str, key: str, before: int) -> DataFrame:
        """The last batch of each key."""
        return self._read(name, INDEXES[name], before).groupBy(key).agg(F.max("batch").alias("batch"))

    def current(self, name: str, before: int = 1 << 30) -> DataFrame:
        """A table as it was before a batch."""
        schema, index, key = TABLES[name]
        return self._read(name, schema, before).join(self._index(index, key, before), [key, "batch"]).select(*self._read(name, schema, 0).drop("batch").columns)

    def paths(self, before: int = 1 << 30) -> DataFrame:
        """Files as the last batch left them, those that are gone included."""
        return self._read("paths", INDEXES["paths"], before).join(self._index("paths", "path", before), ["path", "batch"]).drop("batch")

    def findings(self, before: int = 1 << 30) -> DataFrame:
        across = self._read("across", _FINDING, before)
        last = across.select("batch").unionByName(self._read("judged", INDEXES["judged"], before).select("batch")).agg(F.max("batch").alias("batch"))
        return self.current("found", before).unionByName(across.join(F.broadcast(last), "batch").select(*smells.COLUMNS))  # one row

    def apply(self, batch: int, changed: DataFrame) -> None:
        """Takes a batch's files (path, text, and size and mtime where they are known) into account; batches ascend, and one that is run again replaces itself."""
        for c in ("size", "mtime"):
            if c not in changed.columns:
                changed = changed.withColumn(c, F.lit(None).cast("bigint"))
        changed = stored(changed.select("path", "text", "size", "mtime"))
        alive = changed.where("text is not null")
        extract = python_code.extract(alive, self.module) if self.lang == "python" else lexical.extract(alive, self.module, self.lang)
        self._write("rows", batch, extract)
        text = F.col("text")
        self._write("paths", batch, changed.select("path", text.isNotNull().alias("alive"), frontends.full_lines(text).alias("whole"), frontends.generated(text).alias("generated"), "size", "mtime"))
        files = changed.select("path")
        old, new = self._declared(batch), self._declared(batch + 1)
        old_c, new_c = stored(old.join(files, "path", "left_semi")), stored(new.join(files, "path", "left_semi"))
        both = old_c.unionByName(new_c)
        homes = both.select("pkg").distinct()
        relinked = stored(self._relinked(old, new, homes, both.select("short").distinct(), files))
        self._write("links", batch, self._links(new, relinked))
        self._write("linked", batch, relinked)
        self._write("judged", batch, self._touched(batch, old_c, new, homes, relinked))
        judged = self.spark.read.schema(INDEXES["judged"]).parquet(f"{self.at}/judged/batch={batch}")
        self._write("found", batch, self._judge(batch, new, judged))
        self._write("across", batch, self._judge_packages(batch, new))

    def _declared(self, before: int) -> DataFrame:
        return self.current("rows", before).where("error = ''").withColumn("key", F.expr(KEY))

    def _relinked(self, old: DataFrame, new: DataFrame, homes: DataFrame, names: DataFrame, files: DataFrame) -> DataFrame:
        """Files whose references may mean something else now."""
        mods = [d.join(homes, "pkg", "left_semi").select("pkg", F.explode("mods").alias("mod")).distinct() for d in (old, new)]
        seen = new.select("path", "pkg", F.explode("imports").alias("mod")).distinct()
        shifted = mods[0].exceptAll(mods[1]).unionByName(mods[1].exceptAll(mods[0])).select("mod").distinct()
        by_module = seen.join(shifted, "mod", "left_semi").select("path")
        known = mods[0].unionByName(mods[1]).select("mod").distinct()
        sees = seen.join(known, "mod", "left_semi").select("path").union(new.join(homes, "pkg", "left_semi").select("path")).distinct()
        uses = new.select("path", F.explode("refs.name").alias("short")).distinct().join(names, "short", "left_semi").select("path").distinct()
        return files.unionByName(by_module).unionByName(uses.join(sees, "path", "left_semi")).distinct()

    def _seen(self, rows: DataFrame, every: DataFrame) -> DataFrame:
        """path, pkg, test and each package that a file imports."""
        modules = every.select(F.col("pkg").alias("to"), F.explode("mods").alias("mod")).distinct()
        per = rows.groupBy("path").agg(F.bool_and("test").alias("test"))
        return rows.select("path", "pkg", F.explode("imports").alias("mod")).distinct().join(modules, "mod").select("path", "pkg", "to").distinct().join(per, "path")

    def _links(self, new: DataFrame, relinked: DataFrame) -> DataFrame:
        own = new.join(relinked, "path", "left_semi")
        refs = own.select(F.col("key").alias("src"), F.col("short").alias("own"), (F.col("kind") == "method").alias("own_member"), "path", "pkg", F.explode("refs").alias("r"))
        refs = refs.select("src", "own", "own_member", "path", "pkg", F.col("r.name").alias("short"), F.col("r.kind").alias("kind"))
        target = new.select("short", F.col("key").alias("dst"), F.col("pkg").alias("to"), F.col("path").alias("at"), "exported", (F.col("kind") == "method").alias("member"))
        out = linking.named(refs, target, self._seen(own, new).select("path", "to")).groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
        return out.select(F.regexp_replace("src", ":[0-9]+$", "").alias("path"), "src", "dst", "kind", "n")

    def _touched(self, batch: int, old_c: DataFrame, new: DataFrame, homes: DataFrame, relinked: DataFrame) -> DataFrame:
        """Packages whose declarations are judged again: those of changed files, and those at the ends of links that came or went."""
        before, now = (self.current("links", b).join(relinked, "path", "left_semi").select("src", "dst", "kind", "n") for b in (batch, batch + 1))
        moved = before.exceptAll(now).unionByName(now.exceptAll(before))
        ends = moved.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
        owners = new.select("key", "pkg").unionByName(old_c.select("key", "pkg"))
        return homes.unionByName(owners.join(ends, "key", "left_semi").select("pkg")).distinct().select(F.col("pkg").alias("package"))

    def _judge(self, batch: int, new: DataFrame, judged: DataFrame) -> DataFrame:
        """Findings about declarations and files of packages, from these, links at them and what stands at their other ends."""
        d = new.join(judged.withColumnRenamed("package", "pkg"), "pkg", "left_semi")
        d = python_code.identified(d).join(self.paths(batch + 1).select("path", "generated", "whole"), "path")
        d = stored(frontends.completed(d).withColumns({"k": F.col("ord"), "b": F.lit(0)}).select("key", "whole", *frontends.COLUMNS.split(", ")))
        ids = d.select("key", "id", "pkg")
        links = self.current("links", batch + 1)
        at = links.join(ids.select(F.col("key").alias("src")), "src", "left_semi").unionByName(links.join(ids.select(F.col("key").alias("dst")), "dst", "left_semi")).distinct()
        others = at.select(F.explode(F.array("src", "dst")).alias("key")).distinct().join(ids.select("key"), "key", "left_anti")
        others = new.join(others, "key", "left_semi").select("key", F.col("key").alias("id"), "pkg")
        ends = ids.unionByName(others)
        src, dst = (ends.select(F.col("key").alias(x), F.col("id").alias(f"{x}_id"), F.col("pkg").alias(f"{x}_pkg")) for x in ("src", "dst"))
        edges = stored(at.join(src, "src").join(dst, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind", "n", "dst_pkg"))
        g = Graph(self.spark, None, module=self.module, lang=self.lang)
        # the other ends are known by package alone, and none of them is judged: they count as tests
        g.given["decls"] = d.drop("key", "whole").unionByName(others.select("id", "pkg", F.lit(True).alias("test")), allowMissingColumns=True)
        g.given["edges"] = edges.drop("dst_pkg")
        g.given["refs"] = edges.where("kind = 'caller'").groupBy(F.col("src").alias("decl"), F.col("dst_pkg").alias("pkg")).agg(F.sum("n").alias("n"))
        g.given["files"] = d.groupBy("path").agg(F.min("pkg").alias("pkg"), F.bool_and("test").alias("test"), F.bool_or("generated").alias("generated"), F.max("whole").alias("lines")).withColumn("churn", F.lit(0).cast("bigint"))
        return smells.union(g, [r for r in smells.RULES if r not in ACROSS])

    def _judge_packages(self, batch: int, new: DataFrame) -> DataFrame:
        """Findings about packages, from packages, their files and all links of tests."""
        g = Graph(self.spark, None, module=self.module, lang=self.lang)
        per = frontends.completed(new).groupBy("pkg").agg(F.max("pkg_name").alias("name"))
        g.given["packages"] = stored(per.select("pkg", "name", frontends.relative(F.col("pkg"), self.module).alias("rel")))
        g.given["imports"] = stored(self._seen(new, new).where(~F.col("test") & (F.col("pkg") != F.col("to"))).select(F.col("pkg").alias("src"), F.col("to").alias("dst")).distinct())
        g.given["decls"] = new.select(F.col("key").alias("id"), "pkg", "test")
        g.given["files"] = new.groupBy("path").agg(F.min("pkg").alias("pkg"), F.bool_and("test").alias("test"))
        tests = new.where("test").select(F.col("key").alias("src"))
        of_tests = self.current("links", batch + 1).where("kind = 'caller'").join(tests, "src", "left_semi")
        g.given["refs"] = of_tests.join(new.select(F.col("key").alias("dst"), "pkg"), "dst").groupBy(F.col("src").alias("decl"), "pkg").agg(F.sum("n").alias("n"))
        return smells.union(g, ACROSS)

    def compact(self, batch: int) -> None:
        """Makes `batch`, which must come after all others, one that holds every table whole; folders before it may be deleted then."""
        for name in (*TABLES, *INDEXES, "across"):
            if name in TABLES:
                df = self.current(name, batch)
            elif name == "across":
                df = self.findings(batch).where(F.col("rule").isin(*(r.replace("_", "-") for r in ACROSS)))
            elif name == "paths":
                df = self.paths(batch)
            else:
                df = self._read(name, INDEXES[name], batch).drop("batch").distinct()
            self._write(name, batch, stored(df))

    # streams

    def changes(self, root: str, before: int = 1 << 30) -> DataFrame:
        """path, text, size, mtime of a folder's files that differ from the last batch's; those that are gone with a null text.

        The listing is read on the driver (names, sizes and times); contents of what differs are read by tasks.
        """
        now = self.spark.createDataFrame([(p, s, m) for p, s, m in watched(root) if p.endswith(_EXTENSIONS[self.lang])], "path string, size bigint, mtime bigint")
        last = self.paths(before).where("alive").select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
        diff = stored(now.join(last, "path", "full").where(~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime")))).select("path", "size", "mtime"))
        there = [r.path for r in diff.where("size is not null").select("path").collect()]  # what was edited since the last batch
        names = [f"{root.rstrip('/')}/{p}" for p in there]
        if not names:
            return diff.select("path", F.lit(None).cast("string").alias("text"), "size", "mtime")
        texts = self.spark.read.format("binaryFile").load(names)
        start = F.instr("path", root.rstrip("/") + "/") + len(root.rstrip("/")) + 1
        texts = texts.select(F.substr("path", start).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        # a file without bytes isn't read
        return diff.join(texts, "path", "left").select("path", F.when(F.col("size").isNotNull(), F.coalesce("text", F.lit(""))).alias("text"), "size", "mtime")

    def watch(self, root: str, checkpoint: str, every: str = "1 second", after: Callable[[int], None] | None = None) -> StreamingQuery:
        """Follows a folder: at each change of its fingerprint, the files that differ are a batch."""
        self.spark.dataSource.register(FingerprintSource)

        def batch(seen: DataFrame, n: int) -> None:
            if seen.isEmpty():
                return
            self.apply(n, self.changes(root, n))
            if after:
                after(n)

        stream = self.spark.readStream.format("fingerprint").option("root", root).load()
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def follow(self, edits: DataFrame, checkpoint: str, every: str = "1 second") -> StreamingQuery:
        """Follows a stream of edits (n, path, text); of a file's edits in a batch, the last counts."""

        def batch(seen: DataFrame, n: int) -> None:
            last = seen.groupBy("path").agg(F.max_by("text", "n").alias("text"))
            if not last.isEmpty():
                self.apply(n, last)

        return edits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


_EXTENSIONS = {f.lang: f.extensions for f in frontends.FRONTENDS}

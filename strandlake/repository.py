"""A store of sequence graphs: parquet tables by operation, with branches and versions.

Every operation writes the rows it adds below its own folder; a version is the set of operations up to it, less the
masked ones, so that checking one out is choosing which folders are read. Nothing is changed in place.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import scalars as S
from strandlake.operators import edits, entities, graph, paths, versions
from strandlake.sources import readers, writers

_L, _S = T.LongType(), T.StringType()


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


TABLES = {
    "sequences": _schema(hash=_S, sequence_type=_S, sequence=_S, name=_S, file_path=_S, length=_L),
    "nodes": _schema(node_id=_L, sequence_hash=_S, hash=_S),
    "graphs": _schema(id=_L, collection=_S, sample=_S, name=_S),
    "edges": _schema(edge_id=_L, source_node=_L, source_coordinate=_L, source_strand=_S, target_node=_L, target_coordinate=_L, target_strand=_S),
    "members": _schema(bg=_L, edge_id=_L, chromosome_index=_L, phased=T.IntegerType()),
    "paths": _schema(path_id=_L, bg=_L, name=_S, made=_L),
    "path_edges": _schema(path_id=_L, idx=_L, edge_id=_L),
    "accessions": _schema(path_id=_L, name=_S, start=_L, end=_L),
    "accession_edges": _schema(path_id=_L, name=_S, idx=_L, source_node=_L, source_coordinate=_L, source_strand=_S, target_node=_L, target_coordinate=_L, target_strand=_S),
    "files": _schema(id=_L, file_path=_S, file_type=_S),
    "operation_files": _schema(file_addition_id=_L, operation=_S),
}
#: What refers to what: table, column, and the table and key that it names.
REFERENCES = (("members", "edge_id", "edges", "edge_id"), ("path_edges", "edge_id", "edges", "edge_id"), ("nodes", "sequence_hash", "sequences", "hash"), ("edges", "source_node", "nodes", "node_id"), ("edges", "target_node", "nodes", "node_id"), ("paths", "bg", "graphs", "id"), ("members", "bg", "graphs", "id"))
OPERATIONS = _schema(op=_S, parent=_S, branch=_S, kind=_S, made=_L, summary=_S)
EDGE = edits.EDGE


class Repository:
    """Tables and versions below one folder, read and written by Spark."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._log: list[dict] = []
        self._heads: dict[str, str | None] = {"main": None}
        self._masked: set[str] = set()
        self.branch = "main"
        #: The default collection and the remote, if they are set.
        self.settings: dict[str, str] = {}
        self._load()

    # --- state -----------------------------------------------------------------------------------------------------

    def _path(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/state.json")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> None:
        path, fs = self._path()
        if fs.exists(path):
            state = json.loads("".join(r["value"] for r in self.spark.read.option("wholetext", True).text(path.toString()).collect()))
            self._log, self._heads, self._masked, self.branch = state["log"], state["heads"], set(state["masked"]), state["branch"]
            self.settings = state.get("settings", {})

    def _save(self) -> None:
        path, fs = self._path()
        new = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"log": self._log, "heads": self._heads, "masked": sorted(self._masked), "branch": self.branch, "settings": self.settings}).encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(new, path)

    def save(self) -> None:
        """Writes the state; a new store comes about by it."""
        self._save()

    def set(self, name: str, value: str) -> None:
        self.settings[name] = value
        self._save()

    def branches(self) -> list[str]:
        return sorted(self._heads)

    @property
    def head(self) -> str | None:
        return self._heads[self.branch]

    def operations(self) -> DataFrame:
        """The log: op, parent, branch, kind, made (its place), summary."""
        return self.spark.createDataFrame([tuple(r[c] for c in OPERATIONS.names) for r in self._log], OPERATIONS)

    def _chain(self, op: str | None) -> list[str]:
        by, out = {r["op"]: r for r in self._log}, []
        while op is not None:
            out.append(op)
            op = by[op]["parent"]
        return [o for o in reversed(out) if o not in self._masked]

    def table(self, name: str, at: str | None = None) -> DataFrame:
        """A table as of an operation, the current one if none is named."""
        ops = [o for o in self._chain(at or self.head) if name in next(r["tables"] for r in self._log if r["op"] == o)]
        empty = self.spark.createDataFrame([], TABLES[name])
        if not ops:
            return empty
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/ops/{o}/{name}" for o in ops])

    def commit(self, kind: str, rows: dict[str, DataFrame], summary: str = "") -> str:
        """Writes the rows an operation adds. Its name is a hash of its parent and of what it holds."""
        made, written, digest = len(self._log), [], hashlib.sha256((self.head or "").encode())
        at = f"{self.root}/tmp/{uuid.uuid4().hex}"
        for name, df in rows.items():
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]])
            df.write.parquet(f"{at}/{name}")
            back = self.spark.read.schema(TABLES[name]).parquet(f"{at}/{name}")
            n, total = back.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*[F.col(c) for c in back.columns]).cast("decimal(38,0)")), F.lit(0))).first()
            if n:
                written.append(name)
                digest.update(f"{name}:{n}:{total};".encode())
        if not written:
            raise ValueError("there are no changes")
        op = digest.hexdigest()
        path, fs = self._path()
        if any(r["op"] == op for r in self._log):
            if op in self._chain(self.head):
                raise ValueError("the operation exists already")
            # it was reset or is on another branch: it is taken up again
            self._masked.discard(op)
            self._heads[self.branch] = op
            self._save()
            return op
        to = self.spark._jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(to(f"{self.root}/ops"))
        fs.rename(to(at), to(f"{self.root}/ops/{op}"))
        self._log.append({"op": op, "parent": self.head, "branch": self.branch, "kind": kind, "made": made, "summary": summary, "tables": written})
        self._heads[self.branch] = op
        self._save()
        return op

    # --- branches --------------------------------------------------------------------------------------------------

    def create_branch(self, name: str) -> None:
        if name in self._heads:
            raise ValueError(f"the branch {name} exists")
        self._heads[name] = self.head
        self._save()

    def delete_branch(self, name: str) -> None:
        if name == self.branch:
            raise ValueError("the current branch cannot be deleted")
        del self._heads[name]
        self._save()

    def resolve(self, name: str) -> str:
        """An operation by HEAD, HEAD~n, or the start of its hash."""
        if name.startswith("HEAD"):
            chain = self._chain(self.head)
            return chain[-1 - int(name[5:] or 0)] if "~" in name else chain[-1]
        found = [r["op"] for r in self._log if r["op"].startswith(name)]
        if len(found) != 1:
            raise ValueError(f"{name} names {len(found)} operations")
        return found[0]

    def resolve_range(self, text: str) -> list[str]:
        """a..b is the operations after a up to b; commas separate several."""
        out: list[str] = []
        for part in text.split(","):
            if ".." in part:
                a, b = (self.resolve(x) for x in part.split(".."))
                chain = self._chain(b)
                out += chain[chain.index(a) + 1 :]
            else:
                out.append(self.resolve(part))
        return out

    def checkout(self, branch: str | None = None, op: str | None = None) -> None:
        if branch:
            if branch not in self._heads:
                self._heads[branch] = self.head
            self.branch = branch
        if op:
            self._heads[self.branch] = self.resolve(op)
        self._save()

    def reset(self, op: str) -> None:
        """Back to an operation; the later ones of this branch are masked."""
        target = self.resolve(op)
        later = [o for o in self._chain(self.head) if o not in set(self._chain(target))]
        self._heads[self.branch] = target
        self._masked |= {o for o in later if next(r["branch"] for r in self._log if r["op"] == o) == self.branch}
        self._save()

    def missing(self, rows: dict[str, DataFrame]) -> DataFrame:
        """(table, id): what rows of an operation refer to and neither they nor the store hold."""
        def held(name: str, key: str) -> DataFrame:
            here = self.table(name).select(F.col(key).cast("string").alias("id"))
            return here.unionByName(rows[name].select(F.col(key).cast("string").alias("id"))) if name in rows else here

        out = None
        for name, column, of, key in REFERENCES:
            if name not in rows:
                continue
            made = rows[name].select(F.col(column).cast("string").alias(f"{of}_id"))
            if of == "nodes":
                made = made.where(~F.col("nodes_id").isin(str(S.START_NODE), str(S.END_NODE)))
            need = versions.dependencies(made, "id", {of: held(of, key)})
            out = need if out is None else out.unionByName(need)
        return self.spark.createDataFrame([], "`table` string, id string") if out is None else out.distinct()

    def _complete(self, rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
        lost = self.missing(rows).limit(3).collect()
        if lost:
            raise ValueError("the operation needs " + ", ".join(f"{r['table']} {r['id']}" for r in lost))
        return rows

    def apply(self, op: str) -> str:
        """The rows of one operation, added to the current branch as a new operation."""
        source = next(r for r in self._log if r["op"] == self.resolve(op))
        rows = {}
        for name in source["tables"]:
            made = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/ops/{source['op']}/{name}")
            here = self.table(name)
            rows[name] = made.join(here, [made[c].eqNullSafe(here[c]) for c in made.columns], "left_anti")
        return self.commit(f"apply {source['kind']}", self._complete(rows), source["summary"])

    def merge(self, branch: str) -> list[str]:
        """All operations of another branch that this one lacks, oldest first."""
        if branch == self.branch:
            raise ValueError("a branch cannot be merged into itself")
        mine = set(self._chain(self.head))
        missing = [o for o in self._chain(self._heads[branch]) if o not in mine]
        if not missing:
            raise ValueError(f"{branch} has nothing that is missing here")
        return [self.apply(o) for o in missing]

    def path_between(self, source: str, target: str) -> DataFrame:
        pairs = self.spark.createDataFrame([(self.resolve(source), self.resolve(target))], "source string, target string")
        return versions.path_between(self.operations().select("op", "parent"), pairs)

    def log(self) -> DataFrame:
        """The current branch's operations, newest first, the current one marked."""
        chain = {o: i for i, o in enumerate(self._chain(self.head))}
        ops = self.operations()
        place = F.create_map(*[x for o, i in chain.items() for x in (F.lit(o), F.lit(i))]) if chain else F.create_map().cast("map<string,int>")
        return ops.withColumn("place", place[F.col("op")]).where("place is not null").select(F.when(F.col("op") == self.head, ">").otherwise("").alias("mark"), "op", "kind", "summary", "place").orderBy(F.col("place").desc())

    # --- patches and remotes ---------------------------------------------------------------------------------------

    def create_patch(self, ops: str, path: str) -> None:
        """Operations with their rows as gzipped JSON lines."""
        parts = []
        for op in self.resolve_range(ops):
            r = next(x for x in self._log if x["op"] == op)
            for name in r["tables"]:
                rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/ops/{op}/{name}")
                parts.append(rows.select(F.lit(op).alias("op"), F.lit(r["made"]).alias("made"), F.lit(r["kind"]).alias("kind"), F.lit(r["summary"]).alias("summary"), F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row")))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        whole.write.mode("overwrite").option("compression", "gzip").json(path)

    def apply_patch(self, path: str) -> list[str]:
        rows = self.spark.read.schema("op string, made int, kind string, summary string, `table` string, row string").json(path)
        done = []
        for r in rows.select("op", "made", "kind", "summary").distinct().orderBy("made").collect():
            mine = rows.where(F.col("op") == r["op"])
            tables = {t["table"] for t in mine.select("table").distinct().collect()}
            new = {}
            for name in tables:
                made = mine.where(F.col("table") == name).select(F.from_json("row", TABLES[name]).alias("r")).select("r.*")
                here = self.table(name)
                new[name] = made.join(here, [made[c].eqNullSafe(here[c]) for c in made.columns], "left_anti")
            done.append(self.commit(r["kind"], self._complete(new), r["summary"]))
        return done

    def push(self, remote: str) -> int:
        """Copies the operations that a remote folder lacks; how many these were."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        to = jvm.org.apache.hadoop.fs.Path
        fs, far = self._path()[1], to(remote).getFileSystem(conf)
        far.mkdirs(to(f"{remote}/ops"))
        n = 0
        for op in self._chain(self.head):
            if not far.exists(to(f"{remote}/ops/{op}")):
                jvm.org.apache.hadoop.fs.FileUtil.copy(fs, to(f"{self.root}/ops/{op}"), far, to(f"{remote}/ops/{op}"), False, conf)
                n += 1
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, to(f"{self.root}/state.json"), far, to(f"{remote}/state.json"), False, conf)
        return n

    # --- views of the tables ---------------------------------------------------------------------------------------

    def add_file(self, path: str, file_type: str = "") -> int:
        """Notes a file that operations use; its number follows from its path."""
        made = self.spark.createDataFrame([(path, file_type)], "file_path string, file_type string").withColumn("id", S.key_number(F.col("file_path")))
        used = made.select(F.col("id").alias("file_addition_id"), F.lit(self.head).cast("string").alias("operation"))
        number = made.first()["id"]
        self.commit("add file", {"files": self._new("files", made, ["id"]), "operation_files": used}, path)
        return number

    def files_of(self, op: str) -> DataFrame:
        """Files that an operation uses."""
        used = self.table("operation_files").withColumnRenamed("operation", "operation_hash")
        return entities.operation_files(self.table("files"), used).where(F.col("operation_hash") == self.resolve(op)).drop("operation_hash")

    def views(self) -> None:
        """Registers the current tables as temporary views, for ``query``."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    def query(self, sql: str) -> list[tuple]:
        self.views()
        return [tuple(r) for r in self.spark.sql(sql).collect()]

    def graphs(self, collection: str, sample: str | None = None) -> DataFrame:
        return self.table("graphs").where((F.col("collection") == collection) & F.col("sample").eqNullSafe(F.lit(sample)))

    def samples(self) -> DataFrame:
        return self.table("graphs").where("sample is not null").select("sample").distinct()

    def explorer(self, collection: str) -> DataFrame:
        return entities.explorer(self.table("graphs"), collection)

    def edges(self, graphs: DataFrame) -> DataFrame:
        """Edges of graphs, as the graph operators take them."""
        members = self.table("members").join(graphs.select(F.col("id").alias("bg")), "bg", "left_semi")
        return entities.edges_for_graphs(members, self.table("edges")).select("bg", "edge_id", *EDGE, "chromosome_index", "phased")

    def node_texts(self) -> DataFrame:
        return self.table("nodes").join(self.table("sequences").select(F.col("hash").alias("sequence_hash"), "sequence"), "sequence_hash").select("node_id", "sequence").dropDuplicates(["node_id"])

    def current_paths(self, graphs: DataFrame) -> DataFrame:
        p = self.table("paths").join(graphs.select(F.col("id").alias("bg"), F.col("name").alias("graph")), "bg")
        newest = p.groupBy("bg").agg(F.max(F.struct("made", "path_id")).alias("l")).select("bg", F.col("l.path_id").alias("path_id"))
        return p.join(newest, ["bg", "path_id"])

    def path_edges(self, of: DataFrame) -> DataFrame:
        return self.table("path_edges").join(of.select("path_id"), "path_id", "left_semi").join(self.table("edges"), "edge_id")

    def path_blocks(self, of: DataFrame) -> DataFrame:
        """Blocks with offsets of paths."""
        return paths.path_blocks(paths.blocks_from_edges(self.path_edges(of)))

    def sequences_of(self, collection: str, sample: str | None = None) -> DataFrame:
        """(name, sequence) of the current path of each graph."""
        p = self.current_paths(self.graphs(collection, sample))
        return paths.path_sequence(self.path_blocks(p), self.node_texts()).join(p.select("path_id", "graph"), "path_id").select(F.col("graph").alias("name"), "sequence")

    def all_sequences(self, collection: str, sample: str | None = None, prune: bool = True) -> DataFrame:
        """(bg, sequence): every text that the graphs of a sample can spell."""
        return graph.all_sequences(self.edges(self.graphs(collection, sample)), self.node_texts(), prune)

    def graph_dict(self, graph_id: int) -> dict:
        """One graph as nodes and edges, for a drawing or another library."""
        e = self.edges(self.table("graphs").where(F.col("id") == graph_id))
        split = graph.blocks(e)
        linked = graph.block_edges(e, split)
        key = lambda r, p: (r[f"{p}_node"], r[f"{p}_start"], r[f"{p}_end"])
        return {"nodes": [(r["node_id"], r["start"], r["end"]) for r in split.collect()], "edges": [(key(r, "s"), key(r, "t"), r["edge_id"]) for r in linked.collect()]}

    # --- imports and updates ---------------------------------------------------------------------------------------

    def _edge_rows(self, e: DataFrame) -> DataFrame:
        return e.select(*EDGE, S.key_number(F.concat_ws(":", *EDGE)).alias("edge_id")).distinct()

    def _new(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows whose key a table does not have yet, one a key."""
        rows = rows.select(*[f.name for f in TABLES[name]]).dropDuplicates(keys)
        here = self.table(name).select(*keys)
        return rows.join(here, [rows[k].eqNullSafe(here[k]) for k in keys], "left_anti")

    def import_records(self, kind: str, records: DataFrame, collection: str, sample: str | None, summary: str = "") -> str:
        """Records (name, sequence) as graphs of one node each, with a path from START to END."""
        text = F.col("sequence")
        r = records.select("name", text, F.length(text).cast("long").alias("length"), S.sequence_hash(F.lit("DNA"), text, F.lit(""), F.lit("")).alias("hash"))
        place = F.concat_ws("/", F.lit(collection), F.coalesce(F.lit(sample), F.lit("\u0000")), "name")
        r = r.withColumns({"bg": S.key_number(place), "node_hash": F.sha2(F.concat_ws(":", F.lit(collection), "name", "hash"), 256)}).withColumn("node_id", S.key_number(F.col("node_hash"))).withColumn("path_id", S.key_number(F.concat_ws("#", "bg", "hash")))
        plus, zero, one, two = F.lit("+"), F.lit(0).cast("long"), F.lit(S.START_NODE).cast("long"), F.lit(S.END_NODE).cast("long")
        both = F.array(
            F.struct(zero.alias("idx"), one.alias("source_node"), zero.alias("source_coordinate"), plus.alias("source_strand"), F.col("node_id").alias("target_node"), zero.alias("target_coordinate"), plus.alias("target_strand")),
            F.struct((zero + 1).alias("idx"), F.col("node_id").alias("source_node"), F.col("length").alias("source_coordinate"), plus.alias("source_strand"), two.alias("target_node"), zero.alias("target_coordinate"), plus.alias("target_strand")))
        e = r.select("bg", "path_id", F.explode(both).alias("e")).select("bg", "path_id", "e.*")
        e = e.withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE)))
        return self.commit(kind, {
            "sequences": self._new("sequences", r.select("hash", F.lit("DNA").alias("sequence_type"), "sequence", F.lit("").alias("name"), F.lit("").alias("file_path"), "length"), ["hash"]),
            "nodes": self._new("nodes", r.select("node_id", F.col("hash").alias("sequence_hash"), F.col("node_hash").alias("hash")), ["node_id"]),
            "graphs": self._new("graphs", r.select(F.col("bg").alias("id"), F.lit(collection).alias("collection"), F.lit(sample).cast("string").alias("sample"), "name"), ["id"]),
            "edges": self._new("edges", self._edge_rows(e), ["edge_id"]),
            "members": self._new("members", e.select("bg", "edge_id", zero.alias("chromosome_index"), F.lit(0).alias("phased")), ["bg", "edge_id", "chromosome_index", "phased"]),
            "paths": self._new("paths", r.select("path_id", "bg", "name", F.lit(len(self._log)).alias("made")), ["path_id"]),
            "path_edges": self._new("path_edges", e.select("path_id", "idx", "edge_id"), ["path_id", "idx"]),
        }, summary)

    def import_fasta(self, path: str, collection: str, sample: str | None = None) -> str:
        return self.import_records("import fasta", readers.fasta(self.spark, path), collection, sample, path)

    def import_genbank(self, path: str, collection: str, sample: str | None = None) -> str:
        """GenBank records. Where an editing program noted its edits, the original sequence is the path, and the
        edits are changes of it."""
        records = readers.genbank(self.spark, path)
        noted = edits.applied_offsets(readers.genbank_edits(records), ["name"])
        first = self.import_records("import genbank", edits.originals(records, noted), collection, sample, path)
        if not noted.head(1):
            return first
        items = noted.select(F.col("name").alias("graph"), F.col("wt_start").alias("start"), F.col("wt_end").alias("end"), F.col("new").alias("sequence"))
        return self.update_with_edits("import genbank edits", items, collection, sample, sample, chromosome=1)

    def update_with_genbank(self, path: str, collection: str, sample: str, parent: str | None = None) -> str:
        """Edits noted in GenBank records, as a sample."""
        noted = edits.applied_offsets(readers.genbank_edits(readers.genbank(self.spark, path)), ["name"])
        items = noted.select(F.col("name").alias("graph"), F.col("wt_start").alias("start"), F.col("wt_end").alias("end"), F.col("new").alias("sequence"))
        return self.update_with_edits("update genbank", items, collection, sample, parent, chromosome=1)

    def import_gfa(self, path: str, collection: str, sample: str | None = None, name: str = "") -> str:
        """Segments as nodes, links, path and walk steps as edges, paths and walks as paths.

        Segments that nothing enters or leaves get an edge from START or to END.
        """
        g = readers.gfa(self.spark, path)
        place = F.concat_ws("/", F.lit(collection), F.coalesce(F.lit(sample), F.lit("\u0000")), F.lit(name))
        number = lambda c: S.key_number(F.concat_ws(":", place, F.col(c)))
        text = F.upper(F.col("sequence"))
        seg = g["segments"].select("segment", text.alias("sequence"), F.length("sequence").cast("long").alias("length"), number("segment").alias("node_id")).withColumn("hash", S.sequence_hash(F.lit("DNA"), F.col("sequence"), F.lit(""), F.lit("")))
        size = seg.select(F.col("node_id").alias("n"), "length")
        steps = g["paths"].select("name", "step", number("segment").alias("node_id"), "strand").unionByName(g["walks"].select("name", "step", number("segment").alias("node_id"), "strand"))
        steps = steps.join(size, F.col("node_id") == F.col("n")).drop("n")
        one, two, zero = F.lit(S.START_NODE).cast("long"), F.lit(S.END_NODE).cast("long"), F.lit(0).cast("long")
        w = W.partitionBy("name").orderBy("step")
        pe = steps.select("name", F.col("step").cast("long").alias("idx"), F.coalesce(F.lag("node_id").over(w), one).alias("source_node"), F.coalesce(F.lag("length").over(w), zero).alias("source_coordinate"), F.coalesce(F.lag("strand").over(w), F.lit("+")).alias("source_strand"),
                          F.col("node_id").alias("target_node"), zero.alias("target_coordinate"), F.col("strand").alias("target_strand"))
        last = steps.groupBy("name").agg(F.max(F.struct("step", "node_id", "length", "strand")).alias("l"))
        pe = pe.unionByName(last.select("name", (F.col("l.step") + 1).cast("long").alias("idx"), F.col("l.node_id").alias("source_node"), F.col("l.length").alias("source_coordinate"), F.col("l.strand").alias("source_strand"), two.alias("target_node"), zero.alias("target_coordinate"), F.lit("+").alias("target_strand")))
        links = g["links"].select(number("source").alias("source_node"), "source_strand", number("target").alias("target_node"), zero.alias("target_coordinate"), "target_strand").join(size, F.col("source_node") == F.col("n")).withColumnRenamed("length", "source_coordinate")
        e = links.select(*EDGE).unionByName(pe.select(*EDGE)).distinct()
        into, out = e.select(F.col("target_node").alias("node_id")).distinct(), e.select(F.col("source_node").alias("node_id")).distinct()
        plus = F.lit("+")
        e = e.unionByName(seg.join(into, "node_id", "left_anti").select(one.alias("source_node"), zero.alias("source_coordinate"), plus.alias("source_strand"), F.col("node_id").alias("target_node"), zero.alias("target_coordinate"), plus.alias("target_strand")))
        e = e.unionByName(seg.join(out, "node_id", "left_anti").select(F.col("node_id").alias("source_node"), F.col("length").alias("source_coordinate"), plus.alias("source_strand"), two.alias("target_node"), zero.alias("target_coordinate"), plus.alias("target_strand")))
        e = e.withColumns({"edge_id": S.key_number(F.concat_ws(":", *EDGE)), "bg": S.key_number(place)})
        # what neither START nor END is joined to is a ring, and opened
        whole = e.withColumns({"chromosome_index": F.lit(S.NO_CHROMOSOME).cast("long"), "phased": F.lit(0)})
        opened = graph.cycle_breaks(graph.block_edges(whole, graph.blocks(whole)))
        e = e.unionByName(opened.withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE))).select(e.columns))
        pe = pe.withColumns({"edge_id": S.key_number(F.concat_ws(":", *EDGE)), "path_id": S.key_number(F.concat_ws("#", place, "name"))})
        graph_row = self.spark.range(1).select(S.key_number(place).alias("id"), F.lit(collection).alias("collection"), F.lit(sample).cast("string").alias("sample"), F.lit(name).alias("name"))
        return self.commit("import gfa", {
            "sequences": self._new("sequences", seg.select("hash", F.lit("DNA").alias("sequence_type"), "sequence", F.lit("").alias("name"), F.lit("").alias("file_path"), "length"), ["hash"]),
            "nodes": self._new("nodes", seg.select("node_id", F.col("hash").alias("sequence_hash"), F.sha2(F.concat_ws(":", place, "segment"), 256).alias("hash")), ["node_id"]),
            "graphs": self._new("graphs", graph_row, ["id"]), "edges": self._new("edges", self._edge_rows(e), ["edge_id"]),
            "members": self._new("members", e.select("bg", "edge_id", F.lit(S.NO_CHROMOSOME).cast("long").alias("chromosome_index"), F.lit(0).alias("phased")), ["bg", "edge_id", "chromosome_index", "phased"]),
            "paths": self._new("paths", pe.select("path_id", S.key_number(place).alias("bg"), "name", F.lit(len(self._log)).alias("made")), ["path_id"]),
            "path_edges": self._new("path_edges", pe.select("path_id", "idx", "edge_id"), ["path_id", "idx"]),
        }, path)

    def update_with_library(self, parts_path: str, design_path: str, collection: str, sample: str, graph_name: str, start: int, end: int, parent: str | None = None) -> str:
        """All combinations of the parts of a design, one part a slot, in place of [start, end) of a graph."""
        base = self.current_paths(self.graphs(collection, parent)).where(F.col("graph") == graph_name).select("path_id")
        blocks = self.path_blocks(base)
        mark = base.withColumns({"change_id": F.lit(0).cast("long"), "start": F.lit(start).cast("long"), "end": F.lit(end).cast("long"), "node_id": F.lit(-1).cast("long"), "node_start": F.lit(0).cast("long"), "node_end": F.lit(1).cast("long"), "chromosome_index": F.lit(0).cast("long"), "phased": F.lit(0), "preserve": F.lit(False)})
        if edits.out_of_bounds(mark, blocks).head(1):
            raise ValueError("the library lies outside its sequence")
        two = edits.edit_edges(mark, blocks)
        pool = F.lit(0).alias("pool")
        anchors = two.where("target_node = -1").select(pool, F.col("source_node").alias("s_node"), F.col("source_coordinate").alias("s_at")).join(two.where("source_node = -1").select(pool, F.col("target_node").alias("e_node"), F.col("target_coordinate").alias("e_at")), "pool")
        used = readers.library(self.spark, design_path).join(readers.fasta(self.spark, parts_path).select(F.col("name").alias("part"), "sequence"), "part")
        key = F.concat_ws(":", F.lit(collection), F.lit(sample), F.lit(graph_name), F.lit(f"{start}-{end}"), "part", F.concat(F.lit("column-"), F.col("slot").cast("string")))
        used = used.select(pool, "slot", "part", "sequence", F.sha2(key, 256).alias("node_hash"), S.key_number(key).alias("node_id"), F.length("sequence").cast("long").alias("length"), S.sequence_hash(F.lit("DNA"), F.col("sequence"), F.lit(""), F.lit("")).alias("h")).distinct()
        e = edits.library_edges(used, anchors).withColumns({"bg": S.key_number(F.concat_ws("/", F.lit(collection), F.lit(sample), F.lit(graph_name))), "phased": F.lit(0)})
        rows = self.child(collection, parent, sample)
        rows |= {
            "sequences": self._new("sequences", used.select(F.col("h").alias("hash"), F.lit("DNA").alias("sequence_type"), "sequence", F.lit("").alias("name"), F.lit("").alias("file_path"), "length"), ["hash"]),
            "nodes": self._new("nodes", used.select("node_id", F.col("h").alias("sequence_hash"), F.col("node_hash").alias("hash")), ["node_id"]),
            "edges": self._new("edges", self._edge_rows(e), ["edge_id"]), "members": rows["members"].unionByName(self._new("members", e, ["bg", "edge_id", "chromosome_index", "phased"])),
        }
        return self.commit("update library", rows, design_path)

    def child(self, collection: str, parent: str | None, sample: str) -> dict[str, DataFrame]:
        """Rows of a sample whose graphs are copies of its parent's, for those that it does not have."""
        return self.children(self.spark.createDataFrame([(collection, parent, sample)], "collection string, parent string, sample string"))

    def children(self, kids: DataFrame) -> dict[str, DataFrame]:
        """The same for a table of samples (collection, parent, sample), all in one plan; accessions go along."""
        made = entities.child_graphs(self.table("graphs"), kids)
        have = self.table("graphs").select(F.col("id"))
        made = made.join(have, "id", "left_anti")
        copies = made.select("old", F.col("id").alias("new"))
        p = self.table("paths").join(copies, F.col("bg") == F.col("old")).withColumn("to", S.key_number(F.concat_ws("#", "new", "path_id")))
        return {
            "graphs": made.select("id", "collection", "sample", "name"), "members": entities.cloned(self.table("members"), copies),
            "paths": p.select(F.col("to").alias("path_id"), F.col("new").alias("bg"), "name", F.lit(len(self._log)).alias("made")),
            "path_edges": self.table("path_edges").join(p.select("path_id", "to"), "path_id").select(F.col("to").alias("path_id"), "idx", "edge_id"),
        } | {
            name: self.table(name).join(p.select("path_id", "to"), "path_id").withColumn("path_id", F.col("to")).drop("to") for name in ("accessions", "accession_edges")
        }

    def add_accession(self, collection: str, graph_name: str, name: str, start: int, end: int, sample: str | None = None) -> str:
        """Names the part [start, end) of a graph's current path; a path's names are unique."""
        p = self.current_paths(self.graphs(collection, sample).where(F.col("name") == graph_name)).select("path_id")
        made = p.select("path_id", F.lit(name).alias("name"), F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"))
        if self.table("accessions").join(made.select("path_id", "name"), ["path_id", "name"], "left_semi").head(1):
            raise ValueError(f"the path has an accession {name}")
        edges = paths.accession_edges(made, self.path_blocks(p))
        if not edges.head(1):
            raise ValueError("the accession lies outside its path")
        return self.commit("add accession", {"accessions": made, "accession_edges": edges}, name)

    def accession_sequence(self, name: str) -> DataFrame:
        """(path_id, sequence) of the parts of that name."""
        part = self.table("accession_edges").where(F.col("name") == name)
        return paths.path_sequence(paths.blocks_from_edges(part), self.node_texts())

    def update_with_vcf(self, path: str, collection: str, genotype: str | None = None, sample: str | None = None, parent: str | None = None) -> str:
        """Variant calls as changes of each sample's graphs. genotype and sample: for files that lack them."""
        calls = readers.vcf(self.spark, path)
        if genotype:
            calls = calls.withColumns({"gt": F.lit(genotype), "sample": F.lit(sample)}).distinct()
        base = self.current_paths(self.graphs(collection, parent)).select("path_id", F.col("graph").alias("chrom"))
        calls = calls.where("gt is not null").join(F.broadcast(base) if base.count() <= 100_000 else base, "chrom")
        changes = edits.variant_changes(calls).withColumn("change_id", S.key_number(F.concat_ws(":", "sample", "chrom", "node_hash", "chromosome_index", "pos")))
        blocks = self.path_blocks(base)
        if edits.out_of_bounds(changes, blocks).head(1):
            raise ValueError("a variant lies outside its sequence")
        new = edits.edit_edges(changes, blocks)
        rows = self.children(calls.select(F.lit(collection).alias("collection"), F.lit(parent).cast("string").alias("parent"), "sample").distinct())
        place = F.concat_ws("/", F.lit(collection), "sample", "chrom")
        e = new.join(changes.select("change_id", S.key_number(place).alias("bg")), "change_id").withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE)))
        made = changes.select("node_id", "node_hash", "sequence", S.sequence_hash(F.lit("DNA"), F.col("sequence"), F.lit(""), F.lit("")).alias("h"), "node_end").where("node_end > 0")
        members = self._new("members", e, ["bg", "edge_id", "chromosome_index", "phased"])
        acc = edits.variant_accessions(calls)
        rows |= {
            "sequences": self._new("sequences", made.select(F.col("h").alias("hash"), F.lit("DNA").alias("sequence_type"), "sequence", F.lit("").alias("name"), F.lit("").alias("file_path"), F.col("node_end").alias("length")), ["hash"]),
            "nodes": self._new("nodes", made.select("node_id", F.col("h").alias("sequence_hash"), F.col("node_hash").alias("hash")), ["node_id"]),
            "edges": self._new("edges", self._edge_rows(e), ["edge_id"]), "members": rows["members"].unionByName(members),
            "accessions": rows["accessions"].unionByName(self._new("accessions", acc, ["path_id", "name"])),
            "accession_edges": rows["accession_edges"].unionByName(paths.accession_edges(self._new("accessions", acc, ["path_id", "name"]), blocks)),
        }
        return self.commit("update vcf", rows, path)

    def variant_counts(self, path: str, collection: str, parent: str | None = None) -> DataFrame:
        """(sample, chrom, changes): how many changes the calls of a file make on each path of a sample."""
        base = self.current_paths(self.graphs(collection, parent)).select("path_id", F.col("graph").alias("chrom"))
        calls = readers.vcf(self.spark, path).where("gt is not null").join(base, "chrom")
        return edits.variant_changes(calls).groupBy("sample", "chrom").agg(F.count("*").alias("changes"))

    def update_with_edits(self, kind: str, items: DataFrame, collection: str, sample: str, parent: str | None = None, chromosome: int = S.NO_CHROMOSOME, preserve: bool = True) -> str:
        """Edits (graph, start, end, sequence) of a parent's current paths, as a sample; preserve keeps the old bases on a way."""
        base = self.current_paths(self.graphs(collection, parent)).select("path_id", "graph")
        c = items.join(base, "graph")
        key = F.concat_ws(":", "path_id", F.col("start").cast("string"), F.col("end").cast("string"), "sequence")
        c = c.withColumns({"change_id": S.key_number(key), "node_hash": F.sha2(key, 256), "node_id": S.key_number(F.concat(F.lit("n"), key)), "node_start": F.lit(0).cast("long"), "node_end": F.length("sequence").cast("long"), "chromosome_index": F.lit(chromosome).cast("long"), "phased": F.lit(0), "preserve": F.lit(preserve)})
        blocks = self.path_blocks(base)
        if edits.out_of_bounds(c, blocks).head(1):
            raise ValueError("an edit lies outside its sequence")
        e = edits.edit_edges(c, blocks).join(c.select("change_id", S.key_number(F.concat_ws("/", F.lit(collection), F.lit(sample), "graph")).alias("bg")), "change_id").withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE)))
        rows = self.child(collection, parent, sample)
        made = c.where("node_end > 0").select("node_id", "node_hash", "sequence", "node_end", S.sequence_hash(F.lit("DNA"), F.col("sequence"), F.lit(""), F.lit("")).alias("h"))
        rows |= {
            "sequences": self._new("sequences", made.select(F.col("h").alias("hash"), F.lit("DNA").alias("sequence_type"), "sequence", F.lit("").alias("name"), F.lit("").alias("file_path"), F.col("node_end").alias("length")), ["hash"]),
            "nodes": self._new("nodes", made.select("node_id", F.col("h").alias("sequence_hash"), F.col("node_hash").alias("hash")), ["node_id"]),
            "edges": self._new("edges", self._edge_rows(e), ["edge_id"]), "members": rows["members"].unionByName(self._new("members", e, ["bg", "edge_id", "chromosome_index", "phased"])),
        }
        return self.commit(kind, rows)

    def update_with_fasta(self, path: str, collection: str, sample: str, graph_name: str, start: int, end: int, parent: str | None = None) -> str:
        items = readers.fasta(self.spark, path).select(F.lit(graph_name).alias("graph"), F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"), "sequence")
        return self.update_with_edits("update fasta", items, collection, sample, parent)

    # --- exports ---------------------------------------------------------------------------------------------------

    def export_fasta(self, path: str, collection: str, sample: str | None = None) -> None:
        rows = self.sequences_of(collection, sample)
        writers.write_lines(rows.select(writers.fasta_lines(F.col("name"), F.col("sequence")).alias("value")), path)

    def gfa(self, collection: str, sample: str | None = None, max_size: int | None = None) -> DataFrame:
        g = self.graphs(collection, sample)
        p = self.current_paths(g)
        blocks = self.path_blocks(p).join(p.select("path_id", "bg"), "path_id").select("bg", "path_id", "idx", "node_id", "seq_start", "seq_end", "strand")
        return writers.gfa_of(self.edges(g), blocks, self.node_texts(), p.select("path_id", "name"), max_size)

    def export_gfa(self, path: str, collection: str, sample: str | None = None, max_size: int | None = None) -> None:
        writers.write_lines(self.gfa(collection, sample, max_size).orderBy(F.when(F.col("kind") == "S", 0).when(F.col("kind") == "L", 1).otherwise(2), "value"), path)

    def translate_bed(self, path: str, collection: str, sample: str | None = None) -> DataFrame:
        """BED records as pieces named by node: name, start, end, rest."""
        p = self.current_paths(self.graphs(collection, sample)).select("path_id", F.col("graph").alias("chrom"))
        r = readers.bed(self.spark, path).withColumn("record_id", F.monotonically_increasing_id()).join(p, "chrom")
        return paths.translate(r.select("path_id", "record_id", "start", "end"), self.path_blocks(p)).join(r.select("record_id", "rest"), "record_id").select("name", "start", "end", "rest")

    def propagate_gff(self, path: str, collection: str, source: str | None, target: str | None) -> DataFrame:
        """GFF annotations of one sample's paths on another's: name, start, end; those without a place are dropped."""
        a, b = (self.current_paths(self.graphs(collection, s)) for s in (source, target))
        pairs = a.select(F.col("path_id").alias("a_path"), "graph").join(b.select(F.col("path_id").alias("b_path"), "graph"), "graph")
        m = paths.block_mappings(self.path_blocks(a), self.path_blocks(b), pairs.select("a_path", "b_path"))
        r = readers.gff(self.spark, path).select(F.col("chrom").alias("graph"), F.col("attributes").alias("name"), "start", "end")
        return paths.propagate(r.join(pairs.select("graph", "a_path").distinct(), "graph").select("a_path", "name", "start", "end"), m).select("name", "start", "end")

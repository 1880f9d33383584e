"""Readers and writers of graphs, questions, theories and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import DEFAULT_TYPE

PROPS = "map<string,string>"


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, type, props), edges(src, rel, dst, props)) of a property-graph file with nodes and edges."""
    schema = f"name string, nodes array<struct<id:string,type:string,props:{PROPS}>>, edges array<struct<source:string,relation:string,target:string,props:{PROPS}>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.id", F.coalesce("n.type", F.lit(DEFAULT_TYPE)).alias("type"), "n.props").dropDuplicates(["id"])
    edges = doc.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.relation").alias("rel"), F.col("e.target").alias("dst"), "e.props")
    return nodes, edges.dropDuplicates(["src", "rel", "dst"])


def write_json(nodes: DataFrame, edges: DataFrame, path: str, name: str = "graph") -> None:
    """The inverse of read_json, as one file: for graphs that one task can hold; write_tables has no such bound."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "type"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("rel").alias("relation"), F.col("dst").alias("target")))).alias("edges"))
    n.crossJoin(e).select(F.lit(name).alias("name"), "nodes", "edges").coalesce(1).write.mode("overwrite").json(path)


def write_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet, edges by relation, so that a rule reads just its relations."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(src, rel, dst) of a file with header source, relation, target."""
    rows = spark.read.schema("source string, relation string, target string").csv(path, header=True)
    return rows.select(F.col("source").alias("src"), F.col("relation").alias("rel"), F.col("target").alias("dst")).distinct()


def read_triples(spark: SparkSession, path: str, sep: str = "\t", limit: int | None = None) -> DataFrame:
    """(src, rel, dst) of lines with three fields or more; blank lines and # comments are left out."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = lines.select(F.split("value", "\\Q" + sep + "\\E").alias("p")).filter(F.size("p") >= 3)
    rows = parts.select(F.trim(F.get("p", 0)).alias("src"), F.trim(F.get("p", 1)).alias("rel"), F.trim(F.get("p", 2)).alias("dst"))
    return rows if limit is None else rows.limit(limit)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_splits(spark: SparkSession, root: str) -> DataFrame:
    """Triples of train.txt, valid.txt and test.txt with split; an error names the splits that are missing."""
    names = ("train", "valid", "test")
    if missing := [s for s in names if not exists(spark, f"{root}/{s}.txt")]:
        raise FileNotFoundError(f"{root} lacks {', '.join(f'{s}.txt' for s in missing)}")
    out = None
    for s in names:
        rows = read_triples(spark, f"{root}/{s}.txt").withColumn("split", F.lit(s))
        out = rows if out is None else out.unionByName(rows)
    return out


def dataset_stats(triples: DataFrame) -> DataFrame:
    """One row: distinct entities over heads and tails, relations, and the size of each split."""
    ents = triples.select(F.col("src").alias("e")).union(triples.select("dst")).agg(F.countDistinct("e").alias("entities"))
    sizes = triples.agg(F.countDistinct("rel").alias("relations"), *[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "valid", "test")])
    return ents.crossJoin(sizes)  # a row each


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    return read_triples(spark, path, sep="|")


def parse_questions(lines: DataFrame) -> DataFrame:
    """(question, topic, answers) of lines `question<TAB>a|b`: the topic is what stands in the first brackets."""
    p = lines.filter(F.trim("value") != "").select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 2)
    q = F.trim(F.get("p", 0))
    answers = F.filter(F.transform(F.split(F.get("p", 1), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return p.select(q.alias("question"), F.regexp_extract(q, r"\[(.+?)\]", 1).alias("topic"), answers.alias("answers"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return parse_questions(spark.read.text(path))


ATOM = r'\("([^"]*)" "([^"]*)" "([^"]*)" "([^"]*)"\)'
#: Words that stand for a variable.
ANYONE = ("something", "someone", "somebody", "things")


def parse_atoms(representation):
    """Array of (s, r, o, positive) of all atoms in a text; words for anyone become ?x."""
    groups = [F.regexp_extract_all(representation, F.lit(ATOM), F.lit(i)) for i in range(1, 5)]
    term = lambda x: F.when(F.lower(x).isin(*ANYONE), "?x").otherwise(x)
    z = F.arrays_zip(groups[0].alias("s"), groups[1].alias("r"), groups[2].alias("o"), groups[3].alias("p"))
    return F.transform(z, lambda a: F.struct(term(a["s"]).alias("s"), a["r"].alias("r"), term(a["o"]).alias("o"), (a["p"] == "+").alias("positive")))


def expressible(theories: DataFrame) -> DataFrame:
    """The theories that rules can express."""
    return theories.filter("expressible")


def read_theory_split(spark: SparkSession, root: str, depth: int, split: str = "test", limit: int | None = None) -> DataFrame:
    """read_theories of root/depth-N/meta-SPLIT.jsonl; limit takes the first by id."""
    rows = read_theories(spark, f"{root}/depth-{depth}/meta-{split}.jsonl")
    return rows if limit is None else rows.orderBy("id").limit(limit)


def read_theories(spark: SparkSession, path: str) -> DataFrame:
    """(id, facts, rules, questions, expressible) of JSON lines: a ~ in a rule makes a theory inexpressible, which is counted, not dropped."""
    rep = "map<string,struct<representation:string>>"
    raw = spark.read.schema(f"id string, triples {rep}, rules {rep}, questions map<string,struct<question:string,representation:string,answer:boolean,QDep:int>>").json(path)
    reps = lambda c: F.transform(F.map_values(c), lambda x: x["representation"])
    rule = lambda x: F.struct(parse_atoms(F.split(x, "->")[0]).alias("body"), F.get(parse_atoms(F.split(x, "->")[1]), 0).alias("head"))
    facts = F.flatten(F.transform(reps("triples"), lambda x: parse_atoms(x)))
    questions = F.transform(F.map_values("questions"), lambda q: F.struct(F.get(parse_atoms(q["representation"]), 0).alias("atom"), q["answer"].alias("answer"), q["QDep"].alias("depth")))
    expressible = ~F.exists(reps("rules"), lambda x: F.contains(x, F.lit("~")))
    return raw.select("id", facts.alias("facts"), F.transform(reps("rules"), rule).alias("rules"), questions.alias("questions"), expressible.alias("expressible"))


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Arrow files or streams, one or a folder of them, with the columns of schema; each file is read by a task of its own."""
    return arrow_rows(spark.read.format("binaryFile").load(path).select("content"), schema)


def arrow_rows(blobs: DataFrame, schema: str) -> DataFrame:
    """Rows of blobs(content), each an Arrow file or stream, with the columns of schema."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = blobs.sparkSession.createDataFrame([], schema)
    names, target = empty.columns, to_arrow_schema(empty.schema)

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                buffer = pa.py_buffer(raw.as_py())
                try:
                    got = pa.ipc.open_file(buffer).read_all()
                except pa.ArrowInvalid:
                    got = pa.ipc.open_stream(buffer).read_all()
                yield from got.select(names).cast(target).to_batches()

    return blobs.mapInArrow(run, schema)


def case_slots(cases: DataFrame, slots: list[str], key: str = "case_id") -> DataFrame:
    """(key, slot, value) of cases with an array of strings for each slot: trimmed, lower-cased, distinct and sorted; none where a slot is null or empty."""
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))
    some = lambda c: F.when(F.size(F.coalesce(clean(c), F.array().cast("array<string>"))) == 0, F.array(F.lit("none"))).otherwise(clean(c))
    each = F.array(*[F.struct(F.lit(s).alias("slot"), some(F.col(s)).alias("values")) for s in slots])
    return cases.select(key, F.explode(each).alias("s")).select(key, "s.slot", F.explode("s.values").alias("value"))


def case_ontology(slots: list[str]) -> list[tuple]:
    """Rows of relation types (RELATION_SCHEMA) for case graphs: has_SLOT from Case to Value, and the two verdicts."""
    return [(f"has_{s}", ["Case"], ["Value"], False, False, False, None) for s in slots] + [("violates", ["Case"], ["Article"], False, False, False, None), ("permit", ["Case"], ["Verdict"], False, False, True, None)]


def case_edges(cases: DataFrame) -> DataFrame:
    """(src, rel, dst) of cases(case_id, slot, category): shared nodes slot:value; none is left out but for consent."""
    c = cases.filter((F.col("category") != "none") | (F.col("slot") == "consent_form"))
    return c.select(F.col("case_id").alias("src"), F.concat(F.lit("has_"), F.col("slot")).alias("rel"), F.concat_ws(":", "slot", "category").alias("dst")).distinct()


def save_state(path: str, edges: DataFrame, rules_json: str, episodes: DataFrame | None = None, nodes: DataFrame | None = None) -> None:
    """All that a session knows, one folder a table; loading replaces."""
    spark = edges.sparkSession
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark.createDataFrame([(rules_json,)], "rules string").write.mode("overwrite").parquet(f"{path}/rules")
    for name, df in (("episodes", episodes), ("nodes", nodes)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str) -> dict:
    """{edges, rules, episodes, nodes}: what was saved; None for a table that wasn't."""
    table = lambda name: spark.read.parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else None
    return {"edges": table("edges"), "rules": table("rules").first()[0], "episodes": table("episodes"), "nodes": table("nodes")}


def round_robin(pool: DataFrame, n: int) -> DataFrame:
    """n rows of pool(head, relation) with idx, one of each relation in turn."""
    from pyspark.sql import Window

    by = [F.md5(F.concat_ws("|", "head", "relation")), F.col("head")]
    # the first n of each bucket, then of a relation: no relation is sorted whole in one task
    few = pool.withColumn("turn", F.row_number().over(Window.partitionBy("relation", F.pmod(F.xxhash64("head"), F.lit(64))).orderBy(*by))).filter(F.col("turn") <= n)
    return few.withColumn("turn", F.row_number().over(Window.partitionBy("relation").orderBy(*by))).filter(F.col("turn") <= n).orderBy("turn", "relation").limit(n)


def zipf(pool: DataFrame, n: int, a: float = 1.4, seed: str = "0", cells: int = 4096) -> DataFrame:
    """(idx, item) of n draws from pool(rank, item), rank from 1, with weights 1 / rank ** a; uniforms come from hashes.

    The distribution is summed up in blocks of ranks, and draws meet the items
    by the cell of [0, 1) that they fall in: an equi-join.
    """
    from graphloom.operators.evaluation import running_sum

    w = pool.select("item", "rank", F.pow(F.col("rank").cast("double"), F.lit(-a)).alias("w"))
    total = w.agg(F.sum("w")).first()[0] or 1.0
    cdf = running_sum(w, "w", "rank", None, "upto", before=True).select("item", "rank", (F.col("upto") / total).alias("lo"), F.least((F.col("upto") + F.col("w")) / total, F.lit(1.0)).alias("hi"))
    cell = lambda c: F.least(F.lit(cells - 1), F.floor(c * cells)).cast("int")
    wide = cdf.withColumn("_c", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    draws = pool.sparkSession.range(n).select(F.col("id").alias("idx"), (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "id")), 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("u"))
    hit = draws.withColumn("_c", cell(F.col("u"))).join(wide, "_c").filter((F.col("lo") <= F.col("u")) & ((F.col("u") < F.col("hi")) | (F.col("hi") >= 1 - 1e-12)))
    return hit.groupBy("idx").agg(F.min_by("item", "rank").alias("item"))

"""Source trees, notes, pages and history derived row by row from the sample tables.

Nothing here gathers rows: every file is one table row, so a tree grows with its table and no
file grows with a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.dealing import dealt as by_count

REPO = "sample"
#: Scripts that one task parses, about.
PARSED_ROWS = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table's columns, its rows dealt by key where it has fewer files than there are tasks.

    Spark cannot split a row group, so a table of one would be parsed by one task. What is dealt
    are the columns named, before texts are made of them, in tasks of about `PARSED_ROWS` rows: a
    parse takes long, and few long tasks leave cores idle at their end. A table of many files is
    left as it is.
    """
    rows = table(spark, sf_dir, name).select(key, *columns)
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-rows.count() // PARSED_ROWS),
    )
    return rows if len(rows.inputFiles()) >= tasks else rows.repartition(tasks, key)


def _file(rows: DataFrame, source: str, path: Column, content: Column) -> DataFrame:
    return rows.select(
        F.lit(REPO).alias("repo_id"), F.lit(source).alias("source"),
        path.alias("file_path"), content.alias("content"),
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts importing each other along orders -> customer -> nation -> region."""

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    regions = table(spark, sf_dir, "region")
    rk = F.col("r_regionkey")
    region = _file(
        regions, "code", text("src/region/r", rk, ".ts"),
        text("// ", F.col("r_name"), "\nexport enum Region", rk, " { Zone }\n"),
    )
    nk, nrk = F.col("n_nationkey"), F.col("n_regionkey")
    nation = _file(
        table(spark, sf_dir, "nation"), "code", text("src/nation/n", nk, ".ts"),
        text(
            "import { Region", nrk, " } from '../region/r", nrk, "';\n\n",
            "export interface Nation", nk, " {\n  region: Region", nrk, ";\n}\n",
        ),
    )
    ck, cnk = F.col("c_custkey"), F.col("c_nationkey")
    customer = _file(
        dealt(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name", "c_acctbal"), "code", text("src/customer/c", ck, ".ts"),
        text(
            "import { Nation", cnk, " } from '../nation/n", cnk, ".js';\n",
            "import type { Nation", cnk, " as Home } from \"../nation/n", cnk, "\";\n",
            "/* import { Ghost } from './ghost'; */\n\n",
            "export class Customer", ck, " implements Nation", cnk, " {\n",
            "  home?: Home;\n  name = '", F.col("c_name"), "';\n",
            "  balance(): number {\n    return ", F.col("c_acctbal"), ";\n  }\n}\n",
        ),
    )
    sk, snk = F.col("s_suppkey"), F.col("s_nationkey")
    supplier = _file(
        table(spark, sf_dir, "supplier"), "code", text("src/supplier/s", sk, "/index.ts"),
        text(
            "import * as places from '../../nation/n", snk, "';\n",
            "export const supplier", sk, " = { name: '", F.col("s_name"), "' };\n",
            "export type Site", sk, " = places.Nation", snk, ";\n",
        ),
    )
    ok, ock = F.col("o_orderkey"), F.col("o_custkey")
    orders = _file(
        dealt(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice"), "code", text("src/orders/o", ok, ".tsx"),
        text(
            "import React from 'react';\nimport './missing';\n",
            "import { Customer", ock, " } from '../customer/c", ock, "';\n\n",
            "export class Order", ok, " extends Customer", ock, " {\n",
            "  total(): number { return price", ok, "(", F.col("o_totalprice"), "); }\n}\n\n",
            "function price", ok, "(x: number) { return x; }\n\n",
            "export default function open", ok, "(c: Customer", ock, ") {\n",
            "  return new Order", ok, "();\n}\n",
        ),
    )
    tree = region
    for part in (nation, customer, supplier, orders):
        tree = tree.unionByName(part)
    return tree


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script per document: every line of its text becomes a commented function."""
    doc = F.col("doc_id").cast("string")
    functions = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.concat(
            F.lit("export function d"), doc, F.lit("_l"), i.cast("string"),
            F.lit("() {\n  // "), line, F.lit("\n  return "), i.cast("string"), F.lit(";\n}"),
        ),
    )
    return _file(
        dealt(spark, sf_dir, "documents", "doc_id", "text"), "code", F.concat(F.lit("gen/d"), doc, F.lit(".ts")),
        F.concat(F.lit('import { base } from "./base";\n\n'), F.array_join(functions, "\n"),
                 F.lit("\n")),
    )


def varied_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script per document: its lines as comments, texts, templates and tags of statements."""
    doc, text = F.col("doc_id").cast("string"), F.col("text")

    def statement(line, i):
        n = i.cast("string")
        forms = [
            F.concat(F.lit("import D"), n, F.lit(", {\n  a as b"), n, F.lit(", // "), line, F.lit("\n  type T"), n,
                     F.lit(",\n} from '../m"), n, F.lit("';")),
            F.concat(F.lit("/* "), line, F.lit("\nimport ghost from './none'\n*/ import './side"), n, F.lit("'")),
            F.concat(F.lit("export const v"), n, F.lit(" = `"), line, F.lit(" \\` ${x ? `\nexport let ghost = 1\n` : ''}`;")),
            F.concat(F.lit("export default async function f"), n, F.lit("() { return <p>"), line, F.lit(" http://x.y</p> }")),
            F.concat(F.lit("const s"), n, F.lit(" = \"export class Ghost \" + /[`'{]/.test('"), F.replace(line, F.lit("'")),
                     F.lit("'); export type Y"), n, F.lit(" = 'y'")),
            F.concat(F.lit('import Q from "./it\'s'), n, F.lit('"; // '), line),
            F.concat(F.lit("const t"), n, F.lit(" = css `"), line, F.lit("\nimport ghost from './none';\n`; export let w"), n),
        ]
        chosen = forms[-1]
        for k, form in enumerate(forms[:-1]):
            chosen = F.when(i % len(forms) == k, form).otherwise(chosen)
        return chosen

    body = F.array_join(F.transform(F.split(text, "\n", -1), statement), "\n")
    # Some files begin with a byte-order mark, which is no part of their first statement.
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\ufeff"), body)).otherwise(body)
    return _file(
        dealt(spark, sf_dir, "documents", "doc_id", "text"), "code",
        F.concat(F.lit("gen/d"), doc, F.lit("/x.tsx")), marked,
    )


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown: a later line that starts with A, E, I, O or U is a heading."""
    headed = F.regexp_replace("text", "\n(?=[AEIOU])", "\n## ")
    return _file(
        table(spark, sf_dir, "documents"), "docs",
        F.concat(F.lit("docs/d"), F.col("doc_id"), F.lit(".md")), headed,
    )


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as notes with front matter; system turns have none."""
    role = F.col("role")
    matter = F.concat(
        F.lit("---\nname: turn "), F.col("turn"), F.lit("\ntype: "),
        F.when(role == "assistant", "feedback").otherwise("user"),
        F.lit("\ndescription:  talk "), F.col("conv_id"), F.lit(" \n---\n\n"), F.col("text"),
    )
    return _file(
        table(spark, sf_dir, "conversations"), "memory",
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-t"), F.col("turn"), F.lit(".md")),
        F.when(role == "system", F.col("text")).otherwise(matter),
    )


def wiki_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as wiki pages with the usual header lines and related pages."""
    pid = F.col("page_id")
    return _file(
        table(spark, sf_dir, "pages"), "wiki", F.concat(F.lit("page-"), pid, F.lit(".md")),
        F.concat(
            F.lit("# Page "), pid, F.lit("\n\n**Summary**: Found at "), F.col("url"),
            F.lit("\n\n**Last updated**: 2024-01-15\n\n---\n\n"), F.col("html"),
            F.lit("\n\n## Related pages\n\n- [[page-"), pid + 1, F.lit("]]\n- [[ page-"), pid + 2,
            F.lit(" ]] and [[page-"), pid + 1, F.lit("]]\n"),
        ),
    )


def listing(files: DataFrame) -> DataFrame:
    """(repo_id, source, file_path, content_hash) of a tree."""
    from loomgraph.functions.text import content_hash

    return files.select(
        "repo_id", "source", "file_path", content_hash(F.col("content")).alias("content_hash")
    )


def part_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, their parts as files."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"),
        F.concat(F.lit("part/p"), F.col("l_partkey"), F.lit(".ts")).alias("file"),
    )


def module_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's module file, by brand and type."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit(".ts")).alias(
            "file"
        ),
    )


def module_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, the modules of their parts as files."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    # Dealt by number of rows: ids and paths compress so well that their bytes do not tell.
    count = lines.count()
    parts = by_count(module_of_part(spark, sf_dir), count, "l_partkey")
    return by_count(lines, count, "l_partkey").join(parts.hint("merge"), "l_partkey").select(
        F.col("l_orderkey").alias("commit_id"), "file"
    )


def module_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a batch of issues touching modules."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("issue")
    )
    history = module_history(spark, sf_dir).withColumnRenamed("commit_id", "issue")
    count = table(spark, sf_dir, "lineitem").count()
    touches = by_count(orders, count, "issue").hint("merge").join(by_count(history, count, "issue"), "issue")
    return touches.select("batch", "issue", "file").distinct()

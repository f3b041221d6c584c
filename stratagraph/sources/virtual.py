"""A repository made of the driver's tables: each document is a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ["java", "ts", "sql", "json", "yaml", "properties", "xml", "md", "js", "kt"]

#: The same in SQL, as a common table expression ``files``.
FILES_SQL = f"""
named AS (
  SELECT *, CASE doc_id % 10 {" ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS))} END AS ext FROM documents
),
files AS (
  SELECT doc_id,
    concat(CASE WHEN doc_id % 17 = 0 THEN 'node_modules/' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN 'src/test' ELSE 'src/main' END,
           '/', ext, '/', source, '/', lang, '/',
           CASE WHEN doc_id % 50 = 3 THEN concat('D', doc_id, '/package.json') WHEN doc_id % 50 = 6 THEN concat('D', doc_id, '/pom.xml')
                ELSE concat('D', doc_id, '.', ext) END) AS relative_path,
    n_chars AS size,
    concat(CASE doc_id % 3 WHEN 0 THEN 'spring.x org.springframework ' WHEN 1 THEN 'quarkus. "react" "typescript" ' ELSE '' END, text) AS content
  FROM named
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, relative_path, size, content)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("doc_id")
    ext = F.element_at(F.array(*(F.lit(e) for e in EXTENSIONS)), (n % 10 + 1).cast("int"))
    name = F.when(n % 50 == 3, F.concat(F.lit("D"), n, F.lit("/package.json"))).when(n % 50 == 6, F.concat(F.lit("D"), n, F.lit("/pom.xml"))).otherwise(F.concat(F.lit("D"), n, F.lit("."), ext))
    path = F.concat(F.when(n % 17 == 0, "node_modules/").otherwise(""), F.when(n % 5 == 0, "src/test").otherwise("src/main"), F.lit("/"), ext, F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name)
    lead = F.when(n % 3 == 0, "spring.x org.springframework ").when(n % 3 == 1, 'quarkus. "react" "typescript" ').otherwise("")
    return docs.select("doc_id", path.alias("relative_path"), F.col("n_chars").alias("size"), F.concat(lead, "text").alias("content"))


#: Endings of type names by doc_id modulo their number.
SUFFIXES = ["Service", "Manager", "Repository", "Dao", "Controller", "Thing", ""]
LIBRARIES = 9

#: The code files in SQL, as a common table expression ``code``: path, language, package and type name of each document.
CODE_SQL = f"""
numbered AS (SELECT doc_id AS n, doc_id % 4 AS k FROM documents),
code AS (
  SELECT n, k,
    CASE WHEN k = 0 THEN concat('src/', CASE WHEN n % 12 = 0 THEN 'test' ELSE 'main' END, '/java/app/T', n, '.java') WHEN k = 1 THEN concat('web', n % 8, '/c', n, '.ts')
         WHEN k = 2 THEN concat('db/q', n, '.sql') WHEN n % 8 = 7 THEN concat('conf/j', n, '.json') ELSE concat('conf/p', n, '.properties') END AS path,
    CASE WHEN k = 0 THEN 'java' WHEN k = 1 THEN 'typescript' WHEN k = 2 THEN 'sql' WHEN n % 8 = 7 THEN 'json' ELSE 'properties' END AS language,
    CASE WHEN k = 0 THEN 'src/' || CASE WHEN n % 12 = 0 THEN 'test' ELSE 'main' END || '/java' WHEN k = 1 THEN concat('web', n % 8) WHEN k = 2 THEN 'db' ELSE 'conf' END AS root,
    CASE WHEN n % 20 = 0 THEN 'app.g0' ELSE concat('app.g', n % 5, '.h', n % 3) END AS package,
    concat('T', n, CASE n % 7 {" ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(SUFFIXES))} END) AS type
  FROM numbered
)"""


def _type_name(n: Column) -> Column:
    return F.concat(F.lit("T"), n, F.element_at(F.array(*(F.lit(e) for e in SUFFIXES)), (n % len(SUFFIXES) + 1).cast("int")))


def _package(n: Column) -> Column:
    return F.when(n % 20 == 0, "app.g0").otherwise(F.concat(F.lit("app.g"), n % 5, F.lit(".h"), n % 3))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, relative_path, size, content): a repository of code, one file for each document, by the document's number alone.

    Java files import the type of the document four on; TypeScript files import nine libraries, two files of another
    root and one of their own; SQL files define a table and use others; settings name hosts and addresses.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    n = F.col("doc_id")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    mark = lambda a, b: F.when(n % 3 == 0, a).when(n % 3 == 1, b).otherwise("")
    java = say(
        "package ", _package(n), ";\nimport ", _package(n + 4), ".", _type_name(n + 4), ";\nimport java.util.List;\n", mark("@Service ", "@RestController "), "public class ", _type_name(n), " {\n",
        '  @GetMapping("/r', n, '") public String get', n, '() { return "x"; }\n  public void run', n, "(int a) { }\n}\n",
    )
    libraries = [part for i in range(LIBRARIES) for part in ("import { l } from 'lib-", n % 3, f"-{i}';\n")]
    other = (n + 4) % 8
    typescript = say(
        *libraries, "import { x } from '../web", other, "/c", n + 4, "';\nimport { y } from '../web", other, "/c", n + 12, "';\nimport { z } from './c", n + 8, "';\n",
        mark("@Component ", "@Injectable "), "export class View", n, " {}\nfunction bootstrap", n, "() {}\nconst call", n, " = (x) => x;\n",
    )
    sql = say("create table t", n, " (id int);\nselect * from t", n + 4, " join shared", n % 3, ";\ninsert into log", n % 5, " select 1;\n")
    settings = say("server.name=host", n, "\nspring.datasource.url=jdbc:postgresql://db", n % 7, ":5432/app\napi.url=https://api", n % 5, ".example.org/v1\n")
    json = say('{"name": "host', n, '", "baseUrl": "https://api', n % 5, '.example.org/v1"}')
    kind = n % 4
    path = (
        F.when(kind == 0, say("src/", F.when(n % 12 == 0, "test").otherwise("main"), "/java/app/T", n, ".java"))
        .when(kind == 1, say("web", n % 8, "/c", n, ".ts"))
        .when(kind == 2, say("db/q", n, ".sql"))
        .when(n % 8 == 7, say("conf/j", n, ".json"))
        .otherwise(say("conf/p", n, ".properties"))
    )
    content = F.when(kind == 0, java).when(kind == 1, typescript).when(kind == 2, sql).when(n % 8 == 7, json).otherwise(settings)
    return docs.select(n, path.alias("relative_path"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))

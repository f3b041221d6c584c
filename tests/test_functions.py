import zlib

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import ids, naming, paths, text


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_ids_are_crc32_without_leading_zeros(spark):
    for token in ("k25", "src/main/java/A.java", "", "größe"):
        assert one(spark, ids.stable_token(F.lit(token))) == format(zlib.crc32(token.encode()), "x")


@pytest.mark.parametrize(
    "kind, name, language, shown",
    [
        ("MODULE", "org.sample.shapes.CircleMode", "java", "CircleMode"),
        ("CONFIG_ARTIFACT", ".ci/flows/nightly.yml#nightly", "yaml", "nightly"),
        ("FUNCTION", "src/screens/chess/useMoveHints.ts#canUndoMove", "typescript", "canUndoMove"),
        ("CLASS", "net.harbour.crew.CrewService", "java", "CrewService"),
        ("ENDPOINT", "GET /a.b", "java", "GET /a.b"),
        ("CLASS", "not a.name", "typescript", "not a.name"),
        ("MODULE", "a/b/", "java", "a/b/"),
    ],
)
def test_entity_names(spark, kind, name, language, shown):
    assert one(spark, naming.entity_display_name(F.lit(kind), F.lit(name), F.lit(language))) == shown


@pytest.mark.parametrize("kind, name, shown", [("DIRECTORY", "src/main/java/net/harbour/crew", "crew"), ("FILE", "a/CrewService.java", "CrewService.java"), ("PACKAGE", "net.harbour.crew", "crew"), ("REPOSITORY", "x/y", "x/y")])
def test_scope_names(spark, kind, name, shown):
    assert one(spark, naming.scope_display_name(F.lit(kind), F.lit(name))) == shown


def test_paths(spark):
    c = F.lit
    assert one(spark, paths.parent(c("a/b/c"))) == "a/b"
    assert one(spark, paths.parent(c("c"))) is None
    assert one(spark, paths.prefixes(c("a/b/c"))) == ["a", "a/b"]
    assert one(spark, paths.prefixes(c("a"))) == []
    assert one(spark, paths.module_root(c("src/main/java/x/A.java"))) == "src/main/java"
    assert one(spark, paths.module_root(c("backend/src/main/java/A.java"))) == "backend"
    assert one(spark, paths.module_root(c("pom.xml"))) == "pom.xml"
    assert one(spark, paths.resolved(c("src/main/ts/app/main.ts"), c("./http-client"))) == "src/main/ts/app/http-client"
    assert one(spark, paths.resolved(c("src/app/a.ts"), c("../lib/./x"))) == "src/lib/x"
    assert one(spark, paths.resolved(c("a.ts"), c("./x"))) is None
    assert one(spark, paths.resolved(c("a/b.ts"), c("../../x"))) == "../x"


def test_config_values(spark):
    pair = one(spark, text.config_pair(F.lit("json"), F.lit('"baseUrl": "https://api.example.org/v1"')))
    assert (pair.key, pair.value) == ("baseUrl", '"https://api.example.org/v1')
    assert one(spark, text.dependency_targets(F.lit("baseUrl"), F.lit(pair.value))) == ["https://api.example.org/v1"]
    pair = one(spark, text.config_pair(F.lit("properties"), F.lit("spring.datasource.url=jdbc:postgresql://localhost:5432/app")))
    assert pair.key == "spring.datasource.url"
    assert one(spark, text.dependency_targets(F.lit(pair.key), F.lit(pair.value))) == ["jdbc:postgresql://localhost:5432/app", "localhost:5432"]
    assert one(spark, text.datastore_like(F.lit(pair.key), F.lit(pair.value)))
    assert one(spark, text.config_pair(F.lit("xml"), F.lit("<a>b</a>"))).value == "b"
    assert one(spark, text.config_pair(F.lit("xml"), F.lit('x="1" y="2"'))).key == "x"
    assert one(spark, text.config_pair(F.lit("yaml"), F.lit("no pair"))) is None


def test_java_snippets(spark):
    method = '@GetMapping("/orders") public String getOrders() { return "ok"; }'
    assert one(spark, text.java_method_name(F.lit(method))) == "GetMapping"
    assert one(spark, text.endpoint_path(F.lit(method))) == "/orders"
    assert one(spark, text.endpoint_path(F.lit("x"))) == "/"
    assert one(spark, text.java_import(F.lit("import com.example.Foo;"))) == "com.example.Foo"
    assert one(spark, text.package_from_path(F.lit("src/main/java/com/acme/A.java"))) == "com.acme"
    assert one(spark, text.package_from_path(F.lit("A.java"))) == "default"
    assert one(spark, text.http_method(F.lit("PostMapping"))) == "POST"
    assert one(spark, text.http_method(F.lit("RequestMapping"))) == "REQUEST"


def test_sql_snippets(spark):
    said = "insert into a select * from b join c"
    assert one(spark, text.referenced_tables(F.lit(said))) == ["a", "b", "c"]
    assert one(spark, text.created_table(F.lit("CREATE TABLE IF NOT EXISTS orders (id int)"))) == "orders"
    assert one(spark, text.created_table(F.lit(said))) is None

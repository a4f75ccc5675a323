"""Frameworks that manifests declare, by rules that are rows, and the concrete roots of their projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import parent_path, path_prefixes

# What each kind of declaration names, and the framework it stands for: (kind, token, framework, ecosystem, category).
RULES = (
    ("package", "react", "React", "javascript", "frontend"),
    ("package", "next", "Next.js", "javascript", "fullstack"),
    ("package", "vue", "Vue", "javascript", "frontend"),
    ("package", "nuxt", "Nuxt", "javascript", "fullstack"),
    ("package", "@angular/core", "Angular", "javascript", "frontend"),
    ("package", "svelte", "Svelte", "javascript", "frontend"),
    ("package", "@sveltejs/kit", "SvelteKit", "javascript", "fullstack"),
    ("package", "express", "Express", "javascript", "backend"),
    ("package", "@nestjs/core", "NestJS", "javascript", "backend"),
    ("package", "@nestjs/graphql", "GraphQL", "javascript", "backend"),
    ("package", "graphql", "GraphQL", "javascript", "backend"),
    ("package", "@apollo/server", "GraphQL", "javascript", "backend"),
    ("package", "apollo-server", "GraphQL", "javascript", "backend"),
    ("package", "vite", "Vite", "javascript", "build"),
    ("package", "jest", "Jest", "javascript", "test"),
    ("package", "vitest", "Vitest", "javascript", "test"),
    ("script", "react-scripts", "React", "javascript", "frontend"),
    ("script", "next", "Next.js", "javascript", "fullstack"),
    ("script", "vue-cli-service", "Vue", "javascript", "frontend"),
    ("script", "nuxt", "Nuxt", "javascript", "fullstack"),
    ("script", "ng", "Angular", "javascript", "frontend"),
    ("script", "svelte-kit", "SvelteKit", "javascript", "fullstack"),
    ("script", "vite", "Vite", "javascript", "build"),
    ("script", "jest", "Jest", "javascript", "test"),
    ("script", "vitest", "Vitest", "javascript", "test"),
    ("script", "nest", "NestJS", "javascript", "backend"),
    ("python", "django", "Django", "python", "backend"),
    ("python", "flask", "Flask", "python", "backend"),
    ("python", "fastapi", "FastAPI", "python", "backend"),
    ("python", "strawberry-graphql", "GraphQL", "python", "backend"),
    ("python", "graphene", "GraphQL", "python", "backend"),
    ("python", "pytest", "pytest", "python", "test"),
    ("cargo", "axum", "Axum", "rust", "backend"),
    ("cargo", "actix-web", "Actix Web", "rust", "backend"),
    ("cargo", "rocket", "Rocket", "rust", "backend"),
    ("cargo", "tauri", "Tauri", "rust", "desktop"),
    ("go", "github.com/gin-gonic/gin", "Gin", "go", "backend"),
    ("go", "github.com/labstack/echo", "Echo", "go", "backend"),
    ("go", "github.com/gofiber/fiber", "Fiber", "go", "backend"),
    ("jvm", "org.springframework.boot", "Spring Boot", "jvm", "backend"),
    ("jvm", "spring-boot-starter", "Spring Boot", "jvm", "backend"),
    ("composer", "laravel/framework", "Laravel", "php", "backend"),
    ("composer", "symfony/framework-bundle", "Symfony", "php", "backend"),
    ("composer", "symfony/symfony", "Symfony", "php", "backend"),
    ("gem", "rails", "Rails", "ruby", "fullstack"),
)
#: Names of manifests by the ecosystem of their rules.
PYTHON_MANIFESTS = ("pyproject.toml", "requirements.txt", "setup.py", "Pipfile")
JVM_MANIFESTS = ("build.gradle", "build.gradle.kts", "pom.xml")
OTHER_MANIFESTS = ("package.json", "Cargo.toml", "go.mod", "composer.json", "Gemfile")
#: A larger management script is not read.
ENTRYPOINT_BYTES = 1024 * 1024
_COMMAND = r"[A-Za-z0-9_\-/@.:]+"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule string, token string, framework string, ecosystem string, category string")


def manifests(files: DataFrame) -> DataFrame:
    """(root, manifest, content) of the files whose name is a manifest's.  ``files`` has path and content."""
    name = F.substring_index("path", "/", -1)
    return files.filter(name.isin(*PYTHON_MANIFESTS, *JVM_MANIFESTS, *OTHER_MANIFESTS)).select(parent_path(F.col("path")).alias("root"), name.alias("manifest"), "content")


def _name(text: Column) -> Column:
    """A dependency's name: lower case, without quotes and extras, dashes for underscores."""
    return F.translate(F.lower(F.split_part(F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", ""), F.lit("["), F.lit(1))), "_", "-")


def _requirement(text: Column) -> Column:
    """The name at the start of a requirement; empty for options and addresses."""
    bare = F.trim(F.split_part(text, F.lit("#"), F.lit(1)))
    return F.when(bare.rlike(r"^(-|https?://|git\+)"), "").otherwise(_name(F.regexp_extract(bare, r"^([A-Za-z0-9\-_.]*)", 1)))


def _quoted(line: Column) -> Column:
    """The texts in quotes."""
    both = F.regexp_extract_all(line, F.lit(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')"""), F.lit(1))
    return F.transform(both, lambda q: F.trim(F.substring(q, F.lit(2), F.length(q) - 2)))


def declarations(found: DataFrame) -> DataFrame:
    """(root, manifest, rule, token, label): all that manifests declare, whether a rule knows it or not.

    JSON is read by Spark's JSON functions; other formats line by line, where the section of a line is the last header before it.
    """
    out = []

    def add(rows: DataFrame, rule: str, label: Column) -> None:
        out.append(rows.select("root", "manifest", F.lit(rule).alias("rule"), "token", label.alias("label")).filter("token <> ''"))

    keys = lambda field: F.explode(F.json_object_keys(F.get_json_object("content", f"$.{field}"))).alias("token")
    package = found.filter("manifest = 'package.json'")
    for field, label in (("dependencies", "dependency"), ("devDependencies", "devDependency")):
        add(package.select("root", "manifest", keys(field)), "package", F.concat(F.lit(f"package.json {label}: "), "token"))
    scripts = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.get_json_object("content", "$.scripts")), F.lit(f"({_COMMAND})"), F.lit(1)))).alias("token")
    add(package.select("root", "manifest", scripts), "script", F.concat(F.lit("package.json script: "), "token"))
    composer = found.filter("manifest = 'composer.json'")
    for field in ("require", "require-dev"):
        add(composer.select("root", "manifest", F.explode(F.json_object_keys(F.get_json_object("content", f"$['{field}']"))).alias("token")), "composer", F.concat(F.lit(f"composer.json {field}: "), "token"))
    jvm = found.filter(F.col("manifest").isin(*JVM_MANIFESTS))
    for token, what in (("org.springframework.boot", "plugin"), ("spring-boot-starter", "dependency")):
        add(jvm.filter(F.col("content").contains(token)).select("root", "manifest", F.lit(token).alias("token")), "jvm", F.concat("manifest", F.lit(f" {what}: "), "token"))

    lines = found.filter(F.col("manifest").isin(*PYTHON_MANIFESTS, "Cargo.toml", "go.mod", "Gemfile")).select("root", "manifest", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line"))
    bare = lines.withColumn("bare", F.trim(F.split_part("line", F.lit("#"), F.lit(1))))
    python = bare.filter(F.col("manifest").isin(*PYTHON_MANIFESTS))
    key = F.when(F.col("bare").contains("="), F.array(_name(F.split_part("bare", F.lit("="), F.lit(1))))).otherwise(F.expr("CAST(array() AS array<string>)"))
    told = F.when(F.col("manifest") == "requirements.txt", F.array(_requirement(F.col("line")))).otherwise(F.concat(key, F.transform(_quoted(F.col("bare")), _requirement)))
    add(python.select("root", "manifest", F.explode(told).alias("token")), "python", F.concat("manifest", F.lit(" dependency: "), "token"))

    so_far = Window.partitionBy("root", "manifest").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.when(F.col("bare").rlike(r"^\[.*\]$"), F.regexp_replace("bare", r"^\[+|\]+$", ""))
    cargo = bare.filter("manifest = 'Cargo.toml'").withColumn("header", header).withColumn("section", F.last("header", ignorenulls=True).over(so_far))
    in_table = F.col("section").rlike(r"^(?:(?:.*\.)?(?:dev-)?dependencies|build-dependencies)$")
    own = F.regexp_extract("header", r"^(?:(?:.*\.)?(?:dev-)?dependencies|build-dependencies)\.([^.]+)$", 1)
    crate = F.when(F.col("header").isNotNull(), own).when(in_table & F.col("bare").contains("="), F.regexp_replace(F.trim(F.split_part("bare", F.lit("="), F.lit(1))), '^"+|"+$', ""))
    add(cargo.select("root", "manifest", crate.alias("token")), "cargo", F.concat(F.lit("Cargo.toml dependency: "), "token"))

    plain = F.trim(F.split_part("line", F.lit("//"), F.lit(1)))
    go = lines.filter("manifest = 'go.mod'").withColumn("bare", plain).withColumn("mark", F.when(F.col("bare").isin("require (", ")"), F.col("bare"))).withColumn("last", F.last("mark", ignorenulls=True).over(so_far))
    module = F.when(F.col("mark").isNotNull() | (F.col("bare") == ""), "").when(F.col("last") == "require (", F.regexp_extract("bare", r"^(\S+)", 1)).otherwise(F.regexp_extract("bare", r"^require (\S+)", 1))
    modules = go.select("root", "manifest", module.alias("whole")).filter("whole <> ''")
    # A module is its own rule's or that of a path above it.
    add(modules.select("root", "manifest", "whole", F.explode(F.transform(path_prefixes(F.col("whole")), lambda p: p["root"])).alias("token")), "go", F.concat(F.lit("go.mod require: "), "whole"))
    gem = F.when(F.col("bare").rlike(r"""^gem\s*["']"""), F.element_at(_quoted(F.col("bare")), 1))
    add(bare.filter("manifest = 'Gemfile'").select("root", "manifest", F.coalesce(gem, F.lit("")).alias("token")), "gem", F.concat(F.lit("Gemfile gem: "), "token"))
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r)
    return rows


def detected_frameworks(found: DataFrame) -> DataFrame:
    """One row per root and framework: ecosystem, category, the strongest confidence, and all evidence, sorted.  The rules are a constant, broadcast table."""
    known = declarations(found).join(F.broadcast(rules(found.sparkSession)), ["rule", "token"])
    sure = F.max(F.when(F.col("rule") == "script", 0).otherwise(1))
    return known.groupBy("root", "framework").agg(F.min("ecosystem").alias("ecosystem"), F.min("category").alias("category"), F.when(sure == 1, "high").otherwise("medium").alias("confidence"), F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("evidence"))


def django_roots(files: DataFrame) -> DataFrame:
    """(root, evidence) of folders whose manage.py starts Django, by its content."""
    script = files.filter((F.substring_index("path", "/", -1) == "manage.py") & (F.octet_length("content") <= ENTRYPOINT_BYTES))
    starts = F.col("content").contains("DJANGO_SETTINGS_MODULE") & (F.col("content").contains("django.core.management") | F.col("content").contains("execute_from_command_line"))
    return script.filter(starts).select(parent_path(F.col("path")).alias("root"), F.concat(F.lit("manage.py Django entrypoint: "), "path").alias("evidence"))


def with_concrete_roots(frameworks: DataFrame, concrete: DataFrame) -> DataFrame:
    """Concrete Django roots added, and Django roots of manifests dropped where a concrete root lies below."""
    inner = concrete.select(F.col("root").alias("child"), F.inline(path_prefixes(F.col("root"))).alias("up", "depth")).filter("up <> child").select(F.col("up").alias("u")).distinct()
    told = frameworks.select("root", "framework", "evidence").unionByName(concrete.select("root", F.lit("Django").alias("framework"), "evidence"))
    kept = told.join(inner, (F.col("framework") == "Django") & (F.col("root") == F.col("u")), "left_anti")
    return kept.groupBy("root", "framework").agg(F.array_join(F.array_sort(F.collect_set("evidence")), "; ").alias("evidence"))

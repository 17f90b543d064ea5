"""File operators over a listing made from the customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposure.functions import fixed
from exposure.functions import names as nm
from exposure.operators import file_findings as ff
from exposure.operators import findings as fd
from exposure.plans.registry import query, table
from exposure.sources import files as fs

DIRS = "app|node_modules/x|.git|src/deep|build|pkg.egg-info|.ssh|.cursor|.vault"
NAMES = (
    ".env|.env.local|.env.imported|credentials.json|.npmrc|.pypirc|id_rsa|mcp.json|.bash_history|x_history|.gitconfig|main.py|"
    "Dockerfile|photo.png|cache.pyc|notes.MD|.environment|archive.tar.gz|README"
)
PATH = (
    f"concat('/home/u', cast(c_nationkey as varchar(9)), '/', split('{DIRS}', '[|]')[cast(c_custkey % 9 as int)], '/', "
    f"split('{NAMES}', '[|]')[cast(c_custkey % 19 as int)])"
)
PATH_SQL = (
    f"'/home/u' || c_nationkey || '/' || string_split('{DIRS}', '|')[(c_custkey % 9 + 1)::INT] || '/' || string_split('{NAMES}', '|')[(c_custkey % 19 + 1)::INT]"
)
# Contents by name: keys, assignments, a URL, or plain words.
CONTENT = (
    "CASE WHEN c_custkey % 19 IN (0, 1) THEN CASE WHEN c_custkey % 2 = 0 THEN concat('A=1', chr(10), 'B=', chr(10), '# c', chr(10), 'C=x') ELSE '# nothing' END "
    "WHEN c_custkey % 19 = 3 THEN '{\"k1\":1,\"k2\":2}' WHEN c_custkey % 19 = 7 THEN CASE WHEN c_custkey % 2 = 0 THEN '{\"mcpServers\":{},\"v\":1}' ELSE '{\"name\":\"demo\",\"v\":1}' END "
    "WHEN c_custkey % 19 = 10 THEN CASE WHEN c_custkey % 2 = 0 THEN '[url \"https://x\"]' ELSE '[user] name = x' END "
    "WHEN c_custkey % 19 IN (8, 11, 13) THEN concat('api_key = ', md5(c_name)) ELSE 'plain words' END"
)
FILES_SQL = f"f AS (SELECT c_custkey, c_nationkey, {PATH_SQL} AS path, string_split('{NAMES}', '|')[(c_custkey % 19 + 1)::INT] AS name, string_split('{DIRS}', '|')[(c_custkey % 9 + 1)::INT] AS dir FROM customer)"


def files(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.expr(PATH).alias("path"), F.expr(CONTENT).cast("binary").alias("content"))


@query("s2_selected_files", f"WITH {FILES_SQL} SELECT c_custkey, path FROM f WHERE dir NOT IN ('node_modules/x', '.git', 'build', 'pkg.egg-info', '.vault') AND NOT path LIKE '%.pyc'")
def s2_selected_files(spark, sf):
    return fs.select_files(files(spark, sf), private_dirs=(".vault",)).select("c_custkey", "path")


@query("s2_selected_with_excluded", f"WITH {FILES_SQL} SELECT c_custkey, path FROM f WHERE dir <> '.vault' AND NOT path LIKE '%.pyc'")
def s2_selected_with_excluded(spark, sf):
    return fs.select_files(files(spark, sf), private_dirs=(".vault",), include_excluded=True).select("c_custkey", "path")


KIND_SQL = """CASE WHEN name = '.env' OR name LIKE '.env.%' AND NOT name LIKE '%.imported' THEN 'dotenv' WHEN name IN ('credentials.json', '.npmrc', '.pypirc') THEN name WHEN name = 'id_rsa' THEN 'ssh_private_key'
    WHEN name = 'mcp.json' THEN 'mcp_config' WHEN name LIKE '%\\_history' ESCAPE '\\' THEN 'shell_history' WHEN name = '.gitconfig' THEN 'git_config' END"""


@query("s3_scannable_files", f"WITH {FILES_SQL} SELECT name, count(*)::BIGINT AS n FROM f WHERE ({KIND_SQL}) IS NOT NULL OR name IN ('main.py', 'Dockerfile', 'notes.MD', '.environment', 'README') GROUP BY name")
def s3_scannable_files(spark, sf):
    return fs.scannable(files(spark, sf)).groupBy(nm.basename("path").alias("name")).agg(F.count("*").alias("n"))


@query("s5_candidate_files", f"WITH {FILES_SQL} SELECT DISTINCT path FROM f WHERE c_nationkey % 2 = 0 AND dir || '/' || name IN ('.ssh/id_rsa', '.cursor/mcp.json')")
def s5_candidate_files(spark, sf):
    homes = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("/home/u"), "n_nationkey").alias("home"))
    return fs.scan_candidates(files(spark, sf), homes).select("path")


@query("p1_file_kinds", f"WITH {FILES_SQL} SELECT name, {KIND_SQL} AS kind, count(*)::BIGINT AS n FROM f GROUP BY ALL")
def p1_file_kinds(spark, sf):
    return files(spark, sf).groupBy(nm.basename("path").alias("name"), nm.file_kind("path").alias("kind")).agg(F.count("*").alias("n"))


@query("p2_dotenv_names", f"WITH {FILES_SQL} SELECT c_custkey FROM f WHERE name IN ('.env', '.env.local')")
def p2_dotenv_names(spark, sf):
    return files(spark, sf).where(nm.is_dotenv_name(nm.basename("path"))).select("c_custkey")


@query("u6_distinct_files", f"WITH {FILES_SQL} SELECT DISTINCT path FROM f")
def u6_distinct_files(spark, sf):
    return fs.distinct_files(files(spark, sf)).select("path")


def numbered(spark, sf):
    """Every customer as a file of its own."""
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files(spark, sf).withColumn("path", F.concat(parent, F.lit("/"), "c_custkey", F.lit("/"), nm.basename("path"))).drop("c_custkey")


OWN_SQL = f"o AS (SELECT c_custkey AS k, c_custkey % 19 AS m, c_custkey % 2 = 0 AS even, '/home/u' || c_nationkey || '/' || dir || '/' || c_custkey || '/' || name AS path FROM (SELECT customer.c_custkey, customer.c_nationkey, dir, name FROM customer JOIN f USING (c_custkey)))"


@query("a6_dotenv_findings", f"""WITH {FILES_SQL}, {OWN_SQL} SELECT path, CASE WHEN even THEN 'A,C' ELSE '' END AS secret_names, (CASE WHEN even THEN 2 ELSE 0 END)::BIGINT AS secret_count, even AS importable,
    CASE WHEN even THEN 'dotenv, 2 filled name(s)' ELSE 'dotenv without entries' END AS reason FROM o WHERE m IN (0, 1)""")
def a6_dotenv_findings(spark, sf):
    dotenv = numbered(spark, sf).where(nm.file_kind("path") == "dotenv")
    return ff.dotenv_findings(dotenv).select("path", F.array_join("secret_names", ",").alias("secret_names"), "secret_count", "importable", "reason")


@query("a5_file_findings", f"""WITH {FILES_SQL}, {OWN_SQL} SELECT path, kind, secret_count::BIGINT AS secret_count, confidence FROM (
    SELECT path, 'dotenv' AS kind, 2 AS secret_count, 'certain' AS confidence FROM o WHERE m IN (0, 1) AND even
    UNION ALL SELECT path, 'credentials.json', 2, 'certain' FROM o WHERE m = 3 UNION ALL SELECT path, '.npmrc', 1, 'certain' FROM o WHERE m = 4 UNION ALL SELECT path, '.pypirc', 1, 'certain' FROM o WHERE m = 5
    UNION ALL SELECT path, 'ssh_private_key', 1, 'certain' FROM o WHERE m = 6 UNION ALL SELECT path, 'mcp_config', CASE WHEN even THEN 2 ELSE 1 END, CASE WHEN even THEN 'certain' ELSE 'possible' END FROM o WHERE m = 7
    UNION ALL SELECT path, 'shell_history', 1, 'likely' FROM o WHERE m = 8 UNION ALL SELECT path, 'git_config', 1, 'certain' FROM o WHERE m = 10 AND even UNION ALL SELECT path, 'inline', 1, 'likely' FROM o WHERE m = 11)""")
def a5_file_findings(spark, sf):
    return ff.file_findings(numbered(spark, sf)).select("path", "kind", "secret_count", "confidence")


@query("u1_union_scopes", """WITH p AS (SELECT c_custkey AS k, '/f/' || (c_custkey % 700) AS path FROM customer WHERE c_custkey % 3 = 0), d AS (SELECT c_custkey AS k, '/f/' || (c_custkey % 700) AS path FROM customer WHERE c_custkey % 3 <> 0)
    SELECT 'project' AS scope, path, k FROM p UNION ALL SELECT 'deep', path, k FROM d WHERE path NOT IN (SELECT path FROM p)""")
def u1_union_scopes(spark, sf):
    project, deep = scopes(spark, sf)
    return fd.union_scopes(project, deep).select("scope", "path", F.col("secret_count").alias("k"))


@query("u1_first_per_path", """WITH p AS (SELECT c_custkey AS k, '/f/' || (c_custkey % 700) AS path FROM customer WHERE c_custkey % 3 = 0), d AS (SELECT c_custkey AS k, '/f/' || (c_custkey % 700) AS path FROM customer WHERE c_custkey % 3 <> 0)
    SELECT 'project' AS scope, count(*)::BIGINT AS n FROM p UNION ALL SELECT 'deep', count(DISTINCT path) FROM d WHERE path NOT IN (SELECT path FROM p)""")
def u1_first_per_path(spark, sf):
    project, deep = scopes(spark, sf)
    kept = fd.union_scopes(project, deep, "first_per_path")
    # one row for each scope, also where none of its findings is left
    counts = kept.agg(*(F.count_if(F.col("scope") == s).alias(s) for s in ("project", "deep")))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(s).alias("scope"), F.col(s).alias("n")) for s in ("project", "deep")))))


def scopes(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("/f/"), k % 700).alias("path"), k.cast("bigint").alias("secret_count"),
        F.when(k % 2 == 0, fixed.LIKELY).otherwise(fixed.POSSIBLE).alias("confidence"), F.lit("inline").alias("kind"),
        F.when(k % 3 == 0, "project").otherwise("deep").alias("scope"), (k % 3).alias("third"))
    return rows.where("third = 0").drop("third"), rows.where("third <> 0").drop("third")

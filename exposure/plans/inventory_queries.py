"""Dotenv files, manifests, names, imports, set operations and precedence, bound to the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposure.operators import inventory as inv
from exposure.operators import ordered, rules
from exposure.operators import scope as sc
from exposure.plans.registry import query, table
from exposure.sources import lines as src

# One dotenv file per customer, one line per order.
DOTENV_LINE = (
    "CASE o_orderkey % 6 WHEN 0 THEN concat('export KEY_', cast(o_orderkey % 5 as varchar(9)), '=\"', o_orderpriority, ' # kept\"') "
    "WHEN 1 THEN concat('KEY_', cast(o_orderkey % 5 as varchar(9)), '=''', o_orderpriority, '''') "
    "WHEN 2 THEN concat('  KEY_', cast(o_orderkey % 5 as varchar(9)), ' = ', o_orderpriority, ' # note') "
    "WHEN 3 THEN concat('# KEY_9=', o_orderpriority) WHEN 4 THEN concat('KEY_', cast(o_orderkey % 5 as varchar(9)), '=', o_orderstatus, '#x') "
    "ELSE concat('not an entry ', o_orderpriority) END"
)
DOTENV_SQL = """e AS (SELECT '/p/' || o_custkey || '/.env' AS path, o_orderkey AS line_no, 'KEY_' || (o_orderkey % 5) AS name,
    CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority || ' # kept' WHEN 4 THEN o_orderstatus || '#x' ELSE o_orderpriority END AS value
    FROM orders WHERE o_orderkey % 6 IN (0, 1, 2, 4))"""


def dotenv_file_lines(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("/p/"), "o_custkey", F.lit("/.env")).alias("path"), F.col("o_orderkey").alias("line_no"), F.expr(DOTENV_LINE).alias("raw"))


@query("s6_dotenv_lines", f"WITH {DOTENV_SQL} SELECT path, line_no, name, value FROM e")
def s6_dotenv_lines(spark, sf):
    return src.dotenv_lines(dotenv_file_lines(spark, sf))


@query("w2_dotenv_last_wins", f"WITH {DOTENV_SQL} SELECT path, min(line_no) AS line_no, name, arg_max(value, line_no) AS value FROM e GROUP BY path, name")
def w2_dotenv_last_wins(spark, sf):
    return src.dotenv_entries(dotenv_file_lines(spark, sf))


# One manifest per brand: a section of four lines per part.
MANIFEST_LINES = """SELECT concat('/proj/', p_brand) AS path, cast(p_partkey * 10 + j AS int) AS line_no, CASE j
    WHEN 0 THEN CASE WHEN p_partkey % 9 = 0 THEN '[[secret]]' ELSE concat('[secrets.P', cast(p_partkey as varchar(20)), ']') END
    WHEN 1 THEN CASE WHEN p_partkey % 9 = 0 THEN concat('name = "P', cast(p_partkey as varchar(20)), '"') ELSE '# a comment' END
    WHEN 2 THEN CASE WHEN p_size > 25 THEN 'required = true' WHEN p_size > 10 THEN 'required = false  # later' ELSE '' END
    ELSE CASE WHEN p_partkey % 4 = 0 THEN concat('env = "E', cast(p_partkey as varchar(20)), '"') ELSE concat('description = "', p_type, '"') END END AS raw
    FROM part, j"""
MANIFEST_SQL = """m AS (SELECT '/proj/' || p_brand AS project, 'P' || p_partkey AS name, p_size > 25 OR p_size <= 10 AS required,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS description, CASE WHEN p_partkey % 4 = 0 THEN 'E' || p_partkey ELSE 'P' || p_partkey END AS env FROM part)"""


def manifest_lines(spark, sf):
    part = table(spark, sf, "part").withColumn("j", F.explode(F.array(*map(F.lit, range(4)))))
    case = MANIFEST_LINES.split("SELECT ", 1)[1].rsplit("FROM part, j", 1)[0]
    path, rest = case.split(" AS path, ", 1)
    line_no, raw = rest.split(" AS line_no, ", 1)
    return part.select(F.expr(path).alias("path"), F.expr(line_no).alias("line_no"), F.expr(raw.strip().removesuffix(" AS raw")).alias("raw"))


def manifest(spark, sf):
    return src.manifest_rows(manifest_lines(spark, sf)).where("error is null").drop("error")


@query("s7_manifest_rows", f"WITH {MANIFEST_SQL} SELECT project, name, required, description, env, NULL::VARCHAR AS error FROM m")
def s7_manifest_rows(spark, sf):
    return src.manifest_rows(manifest_lines(spark, sf))


@query("w8_carried_sections", """SELECT '/proj/' || p_brand AS path, (p_partkey * 10 + j)::INT AS line_no, (p_partkey * 10)::INT AS section_line FROM part, (VALUES (0), (1), (2), (3)) v(j)""")
def w8_carried_sections(spark, sf):
    header = F.when(F.col("raw").startswith("["), F.col("line_no"))
    return src.carry_section(manifest_lines(spark, sf).withColumn("h", header), "h", "section_line").select("path", "line_no", "section_line")


@query("s8_names_sidecars", "SELECT s_suppkey::VARCHAR AS scope, unnest([s_name, 'N' || s_nationkey]) AS name FROM supplier")
def s8_names_sidecars(spark, sf):
    content = F.to_json(F.struct(F.array("s_name", F.concat(F.lit("N"), "s_nationkey")).alias("names"))).cast("binary")
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), content.alias("content"))
    return src.names(files)


@query("s9_json_keys", "SELECT key, count(*)::BIGINT AS n FROM (SELECT unnest(json_keys(props::JSON)) AS key FROM events) GROUP BY key")
def s9_json_keys(spark, sf):
    return src.json_keys(table(spark, sf, "events").select("props"), "props").groupBy("key").agg(F.count("*").alias("n"))


@query("s14_manifest_merge", """WITH c AS (SELECT 'P' || p_partkey AS name FROM part WHERE p_partkey % 2 = 0 UNION SELECT 'P' || (p_partkey + 1) FROM part WHERE p_partkey % 6 = 0)
    SELECT DISTINCT 'P' || l_partkey AS name, true AS required, '' AS description, 'P' || l_partkey AS env FROM lineitem WHERE 'P' || l_partkey NOT IN (SELECT name FROM c)""")
def s14_manifest_merge(spark, sf):
    have = table(spark, sf, "part").where("p_partkey % 2 = 0").select(
        F.lit("p").alias("project"), F.concat(F.lit("P"), "p_partkey").alias("name"),
        F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("P"), F.col("p_partkey") + 1)).alias("env"))
    want = table(spark, sf, "lineitem").select(F.lit("p").alias("project"), F.concat(F.lit("P"), "l_partkey").alias("name"))
    return inv.manifest_merge(have, want).select("name", "required", "description", "env")


@query("s14_manifest_blocks", f"""WITH {MANIFEST_SQL}, c AS (SELECT project, name FROM m UNION SELECT project, env FROM m), w AS (SELECT DISTINCT '/proj/' || p_brand AS path, unnest(['E' || p_partkey, 'X' || p_partkey]) AS name FROM part)
    SELECT path, name, '[secrets.' || name || ']' || chr(10) || 'required = true' || chr(10) || 'description = ""' || chr(10) || 'env = "' || name || '"' || chr(10) AS block
    FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project = w.path AND c.name = w.name)""")
def s14_manifest_blocks(spark, sf):
    want = table(spark, sf, "part").select(
        F.concat(F.lit("/proj/"), "p_brand").alias("path"),
        F.explode(F.array(F.concat(F.lit("E"), "p_partkey"), F.concat(F.lit("X"), "p_partkey"))).alias("name"))
    return src.manifest_blocks(manifest_lines(spark, sf), want)


@query("s15_names_per_scope", "SELECT DISTINCT c_nationkey::VARCHAR AS scope, c_mktsegment AS name FROM customer ORDER BY 1, 2")
def s15_names_per_scope(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("scope"), F.col("c_mktsegment").alias("name"))
    return inv.sorted_names(names, ("scope",))


@query("k1_sorted_names", "SELECT DISTINCT l_shipdate::DATE AS name FROM lineitem ORDER BY 1")
def k1_sorted_names(spark, sf):
    return inv.sorted_names(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("name")))


PRESENT_SQL = "pr AS (SELECT DISTINCT '/proj/' || p_brand AS project, 'P' || l_partkey AS name FROM part JOIN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) % 3 <> 0) ON p_partkey = l_partkey)"


def present_names(spark, sf):
    sold = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).where("n % 3 <> 0").select("l_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return sold.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.concat(F.lit("/proj/"), "p_brand").alias("project"), F.concat(F.lit("P"), "l_partkey").alias("name")).distinct()


STATUS_SQL = f"""{MANIFEST_SQL}, {PRESENT_SQL}, st AS (SELECT m.project, m.name, m.required, CASE WHEN pr.name IS NOT NULL AND required THEN 'present' WHEN required THEN 'missing'
    WHEN pr.name IS NULL THEN 'optional_absent' ELSE 'optional_present' END AS status FROM m LEFT JOIN pr ON pr.project = m.project AND pr.name = m.name)"""


@query("j2_manifest_status", f"WITH {STATUS_SQL} SELECT project, name, required, status FROM st")
def j2_manifest_status(spark, sf):
    return inv.manifest_status(manifest(spark, sf), present_names(spark, sf))


@query("j2_manifest_check", f"""WITH {STATUS_SQL} SELECT project, count(*) FILTER (status = 'missing') = 0 AS ok, count(*) FILTER (required)::BIGINT AS required, count(*) FILTER (status = 'present')::BIGINT AS present,
    count(*) FILTER (status = 'missing')::BIGINT AS missing, count(*) FILTER (status = 'optional_absent')::BIGINT AS optional_absent,
    coalesce(string_agg(name, ',' ORDER BY name) FILTER (status = 'missing'), '') AS missing_names FROM st GROUP BY project""")
def j2_manifest_check(spark, sf):
    m = manifest(spark, sf)
    checked = inv.manifest_check(m.select("project"), m, present_names(spark, sf))
    return checked.select("project", "ok", "required", "present", "missing", "optional_absent", F.array_join("missing_names", ",").alias("missing_names"))


@query("j3_preflight", f"""WITH {STATUS_SQL}, n AS (SELECT project, count(*) FILTER (status = 'missing') AS n FROM st GROUP BY project), r AS (SELECT l_orderkey, l_linenumber, '/proj/' || p_brand AS project FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT r.project, CASE WHEN coalesce(n, 0) > 0 THEN 'blocked' ELSE 'allowed' END AS decision, max(coalesce(n, 0))::BIGINT AS n_missing, count(*)::BIGINT AS requests FROM r LEFT JOIN n USING (project) GROUP BY ALL""")
def j3_preflight(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/proj/"), "p_brand").alias("project"))
    asked = table(spark, sf, "lineitem").select("l_partkey").join(part, F.col("p_partkey") == F.col("l_partkey")).select("project")
    status = inv.manifest_status(manifest(spark, sf), present_names(spark, sf))
    return inv.preflight(asked, status).groupBy("project", "decision").agg(F.max("n_missing").alias("n_missing"), F.count("*").alias("requests"))


REQUEST_NAMES = "[('U' || user_id), ('K' || (event_id % 7)), event_type]"


def event_requests(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("verb"),
        F.array(F.concat(F.lit("U"), "user_id"), F.concat(F.lit("K"), F.col("event_id") % 7), F.col("event_type")).alias("secret_names"))


INVENTORY_SQL = "inv AS (SELECT 'U' || c_custkey AS name FROM customer WHERE c_custkey % 3 = 0 UNION SELECT unnest(['K1', 'K3', 'view', 'click']))"


def event_inventory(spark, sf):
    users = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("U"), "c_custkey").alias("name"))
    extra = table(spark, sf, "customer").select(F.explode(F.array(*map(F.lit, ("K1", "K3", "view", "click")))).alias("name"))
    return inv.union_names(users, extra)


@query("j4_unknown_names", f"""WITH {INVENTORY_SQL}, r AS (SELECT event_id AS request_id, unnest([0, 1, 2])::INT AS pos, unnest({REQUEST_NAMES}) AS name FROM events)
    SELECT request_id, pos, name FROM r WHERE name NOT IN (SELECT name FROM inv)""")
def j4_unknown_names(spark, sf):
    return inv.unknown_names(event_requests(spark, sf), event_inventory(spark, sf))


@query("j4_denial_reasons", f"""WITH {INVENTORY_SQL}, r AS (SELECT event_id AS request_id, unnest([0, 1, 2])::INT AS pos, unnest({REQUEST_NAMES}) AS name FROM events)
    SELECT request_id, 'unknown secrets: ' || string_agg(name, ', ' ORDER BY pos) AS reason FROM r WHERE name NOT IN (SELECT name FROM inv) GROUP BY request_id""")
def j4_denial_reasons(spark, sf):
    return inv.unknown_denials(event_requests(spark, sf), event_inventory(spark, sf))


# Two slices of customers overlap: one is there, the other comes in from three files.
IMPORT_SQL = """old AS (SELECT 'C' || (c_custkey % 400) AS name, max(c_name) AS value FROM customer WHERE c_custkey % 400 < 150 GROUP BY 1),
    new AS (SELECT c_custkey AS file_order, 'C' || (c_custkey % 400) AS name, c_name AS value FROM customer WHERE c_custkey % 400 >= 100)"""


def import_slices(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("file_order"), F.concat(F.lit("C"), F.col("c_custkey") % 400).alias("name"), F.col("c_name").alias("value"))
    new = c.where("file_order % 400 >= 100")
    old = c.where("file_order % 400 < 150").groupBy("name").agg(F.max("value").alias("value"))
    return new, old


@query("j5_import_decisions", f"""WITH {IMPORT_SQL} SELECT file_order, name, CASE WHEN name IN (SELECT name FROM old) OR row_number() OVER (PARTITION BY name ORDER BY file_order) > 1 THEN 'skipped' ELSE 'imported' END AS decision FROM new""")
def j5_import_decisions(spark, sf):
    new, old = import_slices(spark, sf)
    return inv.import_decisions(new, old)


@query("j5_import_result", f"""WITH {IMPORT_SQL}, f AS (SELECT name, arg_min(value, file_order) AS value FROM new GROUP BY name) SELECT coalesce(old.name, f.name) AS name, coalesce(old.value, f.value) AS value FROM old FULL JOIN f ON old.name = f.name""")
def j5_import_result(spark, sf):
    new, old = import_slices(spark, sf)
    return inv.import_entries(new, old)


@query("j5_import_overwrite", f"""WITH {IMPORT_SQL}, f AS (SELECT name, arg_max(value, file_order) AS value FROM new GROUP BY name) SELECT coalesce(f.name, old.name) AS name, coalesce(f.value, old.value) AS value FROM old FULL JOIN f ON old.name = f.name""")
def j5_import_overwrite(spark, sf):
    new, old = import_slices(spark, sf)
    return inv.import_entries(new, old, "overwrite")


@query("j12_inject_names", f"""WITH r AS (SELECT event_id AS request_id, unnest({REQUEST_NAMES}) AS name FROM events) SELECT request_id, name, CASE WHEN name IN ('K2', 'view', 'K5') THEN 'ENV_' || name ELSE name END AS env FROM r""")
def j12_inject_names(spark, sf):
    # The mapping derives from the requests' own names.
    mapped = table(spark, sf, "events").select(F.explode(F.array(F.concat(F.lit("K"), F.col("event_id") % 7), F.col("event_type"))).alias("name")).distinct()
    mapping = mapped.where("name in ('K2', 'view', 'K5')").select("name", F.concat(F.lit("ENV_"), "name").alias("env"))
    return inv.inject_names(event_requests(spark, sf), mapping)


@query("j15_scope", """WITH r AS (SELECT o_orderkey AS k, '/proj/' || (o_custkey % 20) AS root, CASE WHEN o_orderkey % 11 = 0 THEN '/v/x.bin' END AS flag, o_orderkey % 7 = 0 AS fg, o_orderkey % 5 = 0 AS ng,
      CASE WHEN o_orderkey % 3 = 0 THEN 'stage' END AS env, o_custkey % 20 < 15 AS proj, o_custkey % 20 % 2 = 0 AS ug, CASE WHEN o_custkey % 20 % 3 = 0 THEN 'dev' END AS de FROM orders),
    s AS (SELECT *, CASE WHEN flag IS NOT NULL THEN 'explicit' WHEN fg THEN 'global' WHEN proj THEN 'project' ELSE 'global' END AS scope FROM r),
    e AS (SELECT *, CASE WHEN scope = 'project' THEN coalesce(env, de) END AS env_name FROM s)
    SELECT k, scope, env_name, CASE scope WHEN 'explicit' THEN flag WHEN 'global' THEN '/g/vault.bin' ELSE root || '/.vault' || CASE WHEN env_name IS NOT NULL THEN '/envs/' || env_name ELSE '' END || '/vault.bin' END AS vault_path,
      scope = 'project' AND ug AND NOT ng AS merge_with_global, CASE WHEN scope = 'global' AND env IS NOT NULL THEN 'an environment needs a project vault' END AS error FROM e""")
def j15_scope(spark, sf):
    k = F.col("o_orderkey")
    requests = table(spark, sf, "orders").select(
        k.alias("k"), F.concat(F.lit("/proj/"), F.col("o_custkey") % 20).alias("project_root"), F.when(k % 11 == 0, "/v/x.bin").alias("vault_flag"),
        F.lit(None).cast("string").alias("vault_override"), (k % 7 == 0).alias("force_global"), (k % 5 == 0).alias("no_global"),
        F.when(k % 3 == 0, "stage").alias("env_flag"), F.lit(None).cast("string").alias("env_override"), F.lit("/g/vault.bin").alias("global_vault"), F.lit(True).alias("global_exists"))
    n = F.col("n")
    projects = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("n")).distinct().where("n < 15").select(
        F.concat(F.lit("/proj/"), n).alias("root"), (n % 2 == 0).alias("use_global"), F.when(n % 3 == 0, "dev").alias("default_env"))
    return sc.resolve_scope(requests, projects).select("k", "scope", "env_name", "vault_path", "merge_with_global", "error")


@query("j17_rule_conflicts", """WITH d AS (SELECT left(p_name, 7) AS rule FROM part GROUP BY 1 HAVING count(*) % 2 = 1),
    a AS (SELECT DISTINCT p_name || ' ' || p_type || ':* — note ' || (p_size % 3) AS entry FROM part)
    SELECT entry FROM a WHERE EXISTS (SELECT 1 FROM d WHERE starts_with(replace(trim(string_split(entry, ' — ')[1]), ':*', ' *'), trim(rule)))""")
def j17_rule_conflicts(spark, sf):
    part = table(spark, sf, "part")
    deny = part.groupBy(F.left("p_name", F.lit(7)).alias("entry")).agg(F.count("*").alias("n")).where("n % 2 = 1").select("entry")
    allow = part.select(F.concat("p_name", F.lit(" "), "p_type", F.lit(":* — note "), F.col("p_size") % 3).alias("entry")).distinct()
    return rules.rule_conflicts(allow, deny)


MERGED_SQL = """SELECT 'C' || (c_custkey % 500) AS name, c_nationkey::VARCHAR AS scope, c_custkey AS precedence, c_name AS value FROM customer"""


@query("w1_precedence_merge", f"WITH s AS ({MERGED_SQL}) SELECT name, arg_max(scope, precedence) AS scope, max(precedence) AS precedence, arg_max(value, precedence) AS value FROM s GROUP BY name")
def w1_precedence_merge(spark, sf):
    secrets = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("scope"), F.col("c_custkey").alias("precedence"),
        F.concat(F.lit("C"), F.col("c_custkey") % 500).alias("name"), F.col("c_name").alias("value"))
    return ordered.merge_precedence(secrets)


@query("u2_union_names", "SELECT 'C' || c_custkey AS name FROM customer UNION SELECT CASE WHEN o_orderstatus = 'F' THEN 'C' ELSE 'D' END || o_custkey FROM orders")
def u2_union_names(spark, sf):
    a = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("name"))
    kind = F.when(F.col("o_orderstatus") == "F", "C").otherwise("D")
    return inv.union_names(a, table(spark, sf, "orders").select(F.concat(kind, "o_custkey").alias("name")))


@query("u3_missing_names", "SELECT c_custkey AS name FROM customer EXCEPT SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 10")
def u3_missing_names(spark, sf):
    return inv.missing(table(spark, sf, "customer").select(F.col("c_custkey").alias("name")), table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.count("*").alias("n")).where("n >= 10").select("name"))


@query("u4_refreshed_rules", """WITH r AS (SELECT p_partkey, ['user ' || p_size, 'old ' || (p_size % 4), 'ours a'] AS existing, ['ours a', 'ours ' || (p_size % 3)] AS ours, ['old 1', 'old 2', 'ours a'] AS old FROM part),
    k AS (SELECT *, list_filter(existing, lambda x: NOT (list_contains(old, x) AND NOT list_contains(ours, x))) AS kept FROM r)
    SELECT p_partkey, array_to_string(list_concat(kept, list_filter(ours, lambda x: NOT list_contains(kept, x))), ',') AS rules FROM k""")
def u4_refreshed_rules(spark, sf):
    size = F.col("p_size")
    existing = F.array(F.concat(F.lit("user "), size), F.concat(F.lit("old "), size % 4), F.lit("ours a"))
    ours = F.array(F.lit("ours a"), F.concat(F.lit("ours "), size % 3))
    old = F.array(F.lit("old 1"), F.lit("old 2"), F.lit("ours a"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(rules.refresh_rules(existing, ours, old), ",").alias("rules"))


@query("u5_in_scope", f"""SELECT event_id AS request_id, len(list_filter({REQUEST_NAMES}, lambda x: NOT list_contains(['U' || user_id, 'K1', 'K2', 'K3', 'view', 'click'], x))) = 0 AS in_scope FROM events""")
def u5_in_scope(spark, sf):
    granted = F.concat(F.slice("secret_names", 1, 1), F.array(*map(F.lit, ("K1", "K2", "K3", "view", "click"))))
    return event_requests(spark, sf).select("request_id", inv.in_scope(F.col("secret_names"), granted).alias("in_scope"))


@query("t9_snapshot_refresh", """WITH p AS (SELECT doc_id AS source, text AS content FROM documents WHERE doc_id % 10 < 8), c AS (SELECT doc_id AS source, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS content FROM documents WHERE doc_id % 10 > 1)
    SELECT coalesce(p.source, c.source) AS source, sha256(coalesce(c.content, p.content)) AS sha, CASE WHEN c.content IS NULL AND p.content IS NULL THEN 'unreadable' WHEN c.content IS NULL THEN 'kept' WHEN p.content IS NULL THEN 'new'
      WHEN c.content = p.content THEN 'unchanged' ELSE 'changed' END AS status FROM p FULL JOIN c ON p.source = c.source""")
def t9_snapshot_refresh(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source"), F.col("text").alias("content"))
    s = F.col("source")
    seen = F.when(s % 7 == 0, F.lit(None)).when(s % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    out = inv.snapshot_refresh(docs.where(s % 10 < 8), docs.where(s % 10 > 1).withColumn("content", seen))
    return out.select("source", F.element_at(F.split("fingerprint", ":"), 3).alias("sha"), "status")

"""Column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.functions import (
    address,
    as_list,
    bounded_key,
    build_params,
    canonical_json,
    clean_names,
    dedupe_keep_order,
    event_day,
    extract_attrs,
    full_ref,
    merge_map,
    nested_remove,
    nested_upsert,
    path_get,
    sanitize_key,
    slugify,
    substitute,
    substitute_columns,
    tag_add,
    tag_value,
    targets_of,
)
from tablerecon.functions.documents import parse
from tablerecon.operators.schema import conform_schema
from tablerecon.operators.tenants import substitute_by_row
from tablerecon.suite.registry import Tables, query


def raw_customers(t: Tables) -> DataFrame:
    """Customers as an unclean source: padded names, mixed-case e-mail."""
    parts = F.split("c_name", "#")
    return t.customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lit(" \t"), parts[0], F.lit("  ")).alias("first_name"),
        F.concat(F.lit("\n "), parts[1], F.lit(" \r\n")).alias("last_name"),
        F.nullif(F.concat("c_name", F.lit("@"), "c_mktsegment", F.lit(".COM")),
                 F.concat("c_name", F.lit("@BUILDING.COM"))).alias("email"),
        F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("segment"),
    )


RAW_CUSTOMERS = """raw AS (
  SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name || '@' || c_mktsegment || '.COM' END AS email,
         nullif(c_mktsegment, 'FURNITURE') AS segment FROM customer)"""


@query(
    f"""WITH {RAW_CUSTOMERS}
SELECT customer_id, lower(email) AS email, first_name || ' ' || last_name AS full_name, segment FROM raw""",
    "clean_customers",
)
def _clean_customers(t: Tables) -> DataFrame:
    return clean_names(raw_customers(t)).select("customer_id", "email", "full_name", "segment")


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS event_day, event_type FROM events""", "event_day"
)
def _event_day(t: Tables) -> DataFrame:
    return t.events.select("event_id", event_day(F.col("ts")).alias("event_day"), "event_type")


@query(
    """SELECT p_partkey, replace(replace('${root}/' || p_name || '/${brand}/${missing}', '${root}', 'base/${brand}'),
       '${brand}', 'any') AS path,
       replace(replace(p_brand || '|${root}', '${root}', 'base/${brand}'), '${brand}', 'any') AS tags
FROM part"""
)
def substitute_vars(t: Tables) -> DataFrame:
    """Later variables also replace inside earlier values; unknown names stay."""
    rows = t.part.select(
        "p_partkey",
        F.concat(F.lit("${root}/"), "p_name", F.lit("/${brand}/${missing}")).alias("path"),
        F.array(F.col("p_brand"), F.lit("${root}")).alias("tags"),
        "p_size",
    )
    done = substitute_columns(rows, {"root": "base/${brand}", "brand": "any"})
    return done.select("p_partkey", "path", F.array_join("tags", "|").alias("tags"))


TENANT_SQL = """SELECT c_custkey, replace(replace('${home}/' || c_mktsegment || '/${nation}/${other}',
  '${home}', '${nation}-' || r_name), '${nation}', n_name) AS path
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _tenant_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    variables = nations.select(
        F.col("n_nationkey").alias("tenant"),
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("position"), F.lit("home").alias("name"),
                         F.concat(F.lit("${nation}-"), "r_name").alias("value")),
                F.struct(F.lit(2).alias("position"), F.lit("nation").alias("name"), F.col("n_name").alias("value")),
            )
        ),
    )
    rows = t.customer.select(
        "c_custkey",
        F.col("c_nationkey").alias("tenant"),
        F.concat(F.lit("${home}/"), "c_mktsegment", F.lit("/${nation}/${other}")).alias("path"),
    )
    return rows, variables


@query(TENANT_SQL)
def substitute_by_tenant(t: Tables) -> DataFrame:
    """Every customer's template is filled with its own nation's variables."""
    rows, variables = _tenant_inputs(t)
    return substitute_by_row(rows, variables, "tenant", ["path"]).select("c_custkey", "path")


@query(TENANT_SQL)
def substitute_by_marker(t: Tables) -> DataFrame:
    """The same for tenants with too many variables to carry along."""
    rows, variables = _tenant_inputs(t)
    done = substitute_by_row(rows, variables, "tenant", ["path"], list_limit=0)
    return done.select("c_custkey", "path")


SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'preview')"
SEGMENT = "coalesce(nullif(trim(regexp_replace(upper({0}), '[^A-Z0-9_]+', '_', 'g'), '_'), ''), 'PREVIEW')"


@query(f"SELECT page_id, {SLUG.format('url')} AS slug FROM pages")
def slugify_pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", slugify(F.col("url")).alias("slug"))


@query(f"SELECT p_partkey, {SEGMENT.format('p_name')} AS part_key FROM part")
def sanitize_key_parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", sanitize_key(F.col("p_name")).alias("part_key"))


@query(
    f"""WITH s AS (SELECT doc_id, upper(source) || '_' || upper(lang) AS base, {SLUG.format('text')} AS slug
  FROM documents),
k AS (SELECT doc_id, base, slug, {SEGMENT.format('slug')} AS part FROM s)
SELECT doc_id, CASE WHEN length(base || '__' || part) <= 32 THEN base || '__' || part
  ELSE substr(base, 1, 19) || '__' || substr(part, 1, CAST(greatest(1, 23 - length(substr(base, 1, 19))) AS BIGINT))
       || '_' || upper(substr(sha1(slug), 1, 6)) END AS bounded FROM k"""
)
def bounded_key_documents(t: Tables) -> DataFrame:
    """A key of at most 32 characters from each whole text's slug."""
    base = F.concat(F.upper("source"), F.lit("_"), F.upper("lang"))
    keyed = t.documents.select("doc_id", base.alias("base"), slugify(F.col("text")).alias("slug"))
    return keyed.select("doc_id", bounded_key(F.col("base"), F.col("slug")).alias("bounded"))


EVENT_DOC = """doc AS (SELECT event_id, '{"params":{"k":' || json_extract_string(props, '$.k') || CASE event_type
    WHEN 'click' THEN ',"type":null' WHEN 'error' THEN '' ELSE ',"type":"' || event_type || '"' END
    || '},"z":[1,2],"a":"x"}' AS doc FROM events)"""


def event_docs(t: Tables) -> DataFrame:
    """A JSON document per event; its type is null for clicks and missing for errors."""
    kind = F.col("event_type")
    typed = (
        F.when(kind == "click", F.lit(',"type":null'))
        .when(kind == "error", F.lit(""))
        .otherwise(F.concat(F.lit(',"type":"'), kind, F.lit('"')))
    )
    doc = F.concat(
        F.lit('{"params":{"k":'), F.get_json_object("props", "$.k"), typed, F.lit('},"z":[1,2],"a":"x"}')
    )
    return t.events.select("event_id", doc.alias("doc"))


@query(
    f"""WITH {EVENT_DOC}
SELECT event_id, CASE WHEN json_type(doc, '$.params.type') IS NULL THEN 'none'
  ELSE json_extract_string(doc, '$.params.type') END AS kind FROM doc"""
)
def json_path_event_props(t: Tables) -> DataFrame:
    """The default stands in for a missing path only, not for a JSON null."""
    docs = event_docs(t).select("event_id", parse(F.col("doc")).alias("doc"))
    return docs.select("event_id", path_get(F.col("doc"), "params.type", "none").alias("kind"))


@query(
    f"""WITH {EVENT_DOC}
SELECT event_id, CAST(json_extract_string(doc, '$.params.k') AS BIGINT) AS k,
  CASE WHEN json_type(doc, '$.params.type') IS NULL THEN 'none'
  ELSE json_extract_string(doc, '$.params.type') END AS kind,
  CAST(NULL AS VARCHAR) AS deeper, CAST(7 AS INTEGER) AS level, json_extract_string(doc, '$.a') AS a FROM doc"""
)
def extract_attrs_events(t: Tables) -> DataFrame:
    spec = {
        "k": ("params.k", "bigint"),
        "kind": ("params.type", "string", "none"),
        "deeper": ("params.k.more",),
        "level": ("params.level", "int", 7),
        "a": ("a",),
    }
    return extract_attrs(event_docs(t), "doc", spec, keep=["event_id"])


@query(
    """SELECT p_partkey, '{"brand":"' || p_brand || '"' || CASE WHEN p_type <> 'PROMO'
  THEN ',"type":"' || p_type || '"' ELSE '' END || ',"size":' || p_size || '}' AS params FROM part"""
)
def build_params_part(t: Tables) -> DataFrame:
    fields = {
        "params.brand": F.col("p_brand"),
        "formatType": F.col("p_name"),
        "params.type": F.nullif(F.col("p_type"), F.lit("PROMO")),
        "params.size": F.col("p_size"),
    }
    return t.part.select("p_partkey", build_params(fields).alias("params"))


@query(
    """SELECT p_partkey, nullif(p_type, 'PROMO') || '.' || p_partkey AS address, p_brand || '.' || p_name AS full_ref
FROM part"""
)
def address_keys(t: Tables) -> DataFrame:
    kind = F.nullif(F.col("p_type"), F.lit("PROMO"))
    return t.part.select(
        "p_partkey",
        address(kind, F.col("p_partkey")).alias("address"),
        full_ref(F.col("p_brand"), F.col("p_name")).alias("full_ref"),
    )


@query(
    """SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS INTEGER) AS n_scalar,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS scalar,
  CAST(CASE WHEN event_type = 'click' THEN 0 ELSE 2 END AS INTEGER) AS n_list FROM events"""
)
def as_list_refs(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id",
        F.nullif(F.col("event_type"), F.lit("error")).alias("one"),
        F.when(F.col("event_type") != "click", F.array("event_type", F.lit("x"))).alias("many"),
    )
    one = as_list(F.col("one"), rows.schema["one"].dataType)
    many = as_list(F.col("many"), rows.schema["many"].dataType)
    return rows.select(
        "event_id", F.size(one).alias("n_scalar"), F.array_join(one, ",").alias("scalar"), F.size(many).alias("n_list")
    )


def _tags() -> F.Column:
    return F.array(
        F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:second-"), "lang")
    )


@query("SELECT doc_id, lang AS lang_tag, source AS source_tag, CAST(NULL AS VARCHAR) AS none_tag FROM documents", "tag_value")
def _tag_value(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        tag_value(_tags(), "lang:").alias("lang_tag"),
        tag_value(_tags(), "source:").alias("source_tag"),
        tag_value(_tags(), "owner:").alias("none_tag"),
    )


@query(
    """SELECT doc_id, array_to_string(list_sort(list_distinct(['lang:' || lang, 'source:' || source,
  'lang:second-' || lang, 'preview', 'base:' || source])), ',') AS tags FROM documents""",
    "tag_add",
)
def _tag_add(t: Tables) -> DataFrame:
    new = tag_add(_tags(), "preview", F.concat(F.lit("base:"), "source"), F.concat(F.lit("lang:"), "lang"))
    return t.documents.select("doc_id", F.array_join(new, ",").alias("tags"))


@query(
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
firsts AS (SELECT doc_id, line, min(pos) AS pos FROM lines GROUP BY 1, 2)
SELECT doc_id, CAST(count(*) AS INTEGER) AS lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS text_hash
FROM firsts GROUP BY 1"""
)
def dedupe_targets(t: Tables) -> DataFrame:
    """Lines of every whole text, first occurrence kept."""
    lines = dedupe_keep_order(F.split("text", "\n"))
    return t.documents.select("doc_id", lines.alias("lines")).select(
        "doc_id", F.size("lines").alias("lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("text_hash")
    )


def rules(*names) -> F.Column:
    return F.array(*[F.struct(n.alias("targetProject")) for n in names])


@query(
    """SELECT doc_id, array_to_string(list_sort(list_distinct([source, nullif(lang, 'fr'), source])), ',') AS targets FROM documents"""
)
def sharing_targets(t: Tables) -> DataFrame:
    given = rules(F.col("source"), F.nullif(F.col("lang"), F.lit("fr")), F.col("source"))
    return t.documents.select("doc_id", F.array_join(targets_of(given), ",").alias("targets"))


@query(
    """SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || upper(event_type)
  || '","user":"' || user_id || '"}' AS merged FROM events""",
    "merge_map",
)
def _merge_map(t: Tables) -> DataFrame:
    current = F.create_map(F.lit("type"), "event_type", F.lit("k"), F.get_json_object("props", "$.k"))
    asked = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.upper("event_type"))
    merged = t.events.select("event_id", merge_map(current, asked).alias("m"))
    return merged.select(
        "event_id", canonical_json(F.col("m"), merged.schema["m"].dataType).alias("merged")
    )


@query(
    """SELECT p_partkey, CASE WHEN p_size >= 25
  THEN '[{"type":"DATASET","name":"' || p_brand || '","targets":["T"]},{"type":"FOLDER","name":"' || p_type || '","targets":["A"]}]'
  ELSE '[{"type":"DATASET","name":"' || p_brand || '","targets":["A"]},{"type":"FOLDER","name":"' || p_type
    || '","targets":["A"]},{"type":"DATASET","name":"other","targets":["T"]}]' END AS upserted,
  '[{"type":"DATASET","name":"' || p_brand || '","targets":["A"]}]' AS removed FROM part""",
    "nested_upsert",
)
def _nested_upsert(t: Tables) -> DataFrame:
    """Large parts rewrite their own entry, small ones append a new one."""

    def entry(kind, name, targets):
        return F.struct(kind.alias("type"), name.alias("name"), F.array(targets).alias("targets"))

    entries = F.array(
        entry(F.lit("DATASET"), F.col("p_brand"), F.lit("A")), entry(F.lit("FOLDER"), F.col("p_type"), F.lit("A"))
    )
    wanted = F.when(F.col("p_size") >= 25, F.col("p_brand")).otherwise("other")
    upserted = nested_upsert(
        entries,
        lambda e: (e["type"] == "DATASET") & (e["name"] == wanted),
        lambda e: e.withField("targets", F.array(F.lit("T"))),
        entry(F.lit("DATASET"), wanted, F.lit("T")),
    )
    removed = nested_remove(entries, lambda e: (e["type"] == "FOLDER") & (e["name"] == F.col("p_type")))
    return t.part.select(
        "p_partkey", F.to_json(upserted).alias("upserted"), F.to_json(removed).alias("removed")
    )


@query(
    """SELECT event_id, '{"a":"x","params":{"k":' || json_extract_string(props, '$.k') || CASE event_type
    WHEN 'click' THEN ',"type":null' WHEN 'error' THEN '' ELSE ',"type":"' || event_type || '"' END
    || '},"z":[1,2]}' AS doc FROM events"""
)
def canonical_json_props(t: Tables) -> DataFrame:
    return event_docs(t).select("event_id", canonical_json(F.col("doc")).alias("doc"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS l_quantity,
  TRY_CAST(l_returnflag AS INTEGER) AS l_returnflag, CAST(l_partkey AS VARCHAR) AS l_partkey,
  strftime(l_shipdate, '%Y-%m-%d') AS shipped, CAST(NULL AS VARCHAR) AS l_comment, CAST(count(*) AS BIGINT) AS rows
FROM lineitem GROUP BY ALL"""
)
def conform_schema_lineitem(t: Tables) -> DataFrame:
    """Declared order and types; what cannot be cast or is not there is null."""
    columns = [
        ("l_orderkey", "bigint"),
        ("l_linenumber", "int"),
        ("l_quantity", "int", "pieces"),
        ("l_returnflag", "int"),
        ("l_partkey", "string"),
        ("l_shipdate", "date"),
        ("l_comment", "string"),
    ]
    out = conform_schema(t.lineitem, columns).withColumn("shipped", F.col("l_shipdate").cast("string"))
    out = out.drop("l_shipdate")
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("rows"))


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k,
  '{"k":' || json_extract_string(props, '$.k') || '}' AS doc, value > 0 AS positive FROM events"""
)
def conform_nested_events(t: Tables) -> DataFrame:
    """JSON text declared as a map and as an object."""
    source = t.events.select(
        "event_id", F.col("props").alias("as_map"), F.col("props").alias("as_object"),
        (F.col("value") > 0).cast("string").alias("positive"),
    )
    columns = [("event_id", "bigint"), ("as_map", "map"), ("as_object", "object"), ("positive", "boolean")]
    out = conform_schema(source, columns)
    return out.select("event_id", F.col("as_map")["k"].alias("k"), F.to_json("as_object").alias("doc"), "positive")


@query(
    """SELECT conv_id, turn, replace(text, 'e', 'E') AS text FROM conversations"""
)
def substitute_whole_texts(t: Tables) -> DataFrame:
    """Substitution reaches every marker of a whole text."""
    marked = t.conversations.select("conv_id", "turn", F.replace("text", F.lit("e"), F.lit("${letter}")).alias("text"))
    return marked.withColumn("text", substitute(F.col("text"), {"letter": "E"}))

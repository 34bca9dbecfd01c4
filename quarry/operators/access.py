"""Who may see which chunk.

A chunk's access rule becomes a short list of grant tokens, a principal becomes the list of tokens
it holds, and "may see" becomes "shares a token". Chunks with the same tokens form an access class.
There are far fewer classes than chunks, so the token join runs on classes and chunks are matched by
class alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions.text import has_text
from quarry.session import cut

_SEPARATOR = "\u001e"
#: Principals, and chunks, of a block of pairs.
PRINCIPAL_BLOCK, CHUNK_BLOCK = 1024, 256


def _token(kind: str, tenant: Column, value: Column) -> Column:
    # the tenant's length keeps "a:b" + "c" apart from "a" + "b:c"
    return F.concat(F.lit(kind + ":"), F.length(tenant).cast("string"), F.lit(":"), tenant,
                    F.lit(":"), value)


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def grants() -> Column:
    """Tokens that open a chunk, from its tenant, owner, department, visibility and lists."""
    tenant, visibility = F.col("tenant_id"), F.col("visibility")
    users = F.transform(_strings(F.col("allowed_user_ids")), lambda u: _token("U", tenant, u))
    roles = F.transform(_strings(F.col("allowed_role_ids")), lambda r: _token("R", tenant, r))
    tokens = (F.when(visibility == C.PRIVATE, F.array(_token("P", tenant, F.col("owner_id"))))
              .when(visibility == C.DEPARTMENT,
                    F.array(_token("D", tenant, F.col("department_id"))))
              .when(visibility.isin(C.TENANT, C.PUBLIC), F.array(_token("T", tenant, F.lit(""))))
              .when(visibility == C.CUSTOM, F.concat(users, roles)))
    return F.array_sort(F.array_distinct(F.array_compact(_strings(tokens))))


def principal_tokens() -> Column:
    """Tokens a principal holds, from tenant_id, user_id, department_ids and role_ids."""
    tenant, user = F.col("tenant_id"), F.col("user_id")
    own = F.when(has_text(user), F.array(_token("P", tenant, user), _token("U", tenant, user)))
    departments = F.transform(_strings(F.col("department_ids")), lambda d: _token("D", tenant, d))
    roles = F.transform(_strings(F.col("role_ids")), lambda r: _token("R", tenant, r))
    held = F.concat(F.array(_token("T", tenant, F.lit(""))), _strings(own), departments, roles)
    return F.when(has_text(tenant), F.array_distinct(F.array_compact(held))).otherwise(
        F.array().cast("array<string>"))


def permission_signature() -> Column:
    """Hash that principals with the same rights share."""
    def joined(c):
        return F.array_join(F.array_sort(_strings(F.col(c))), ",")

    raw = F.concat_ws("|", F.coalesce("tenant_id", F.lit("")), F.coalesce("user_id", F.lit("")),
                      joined("department_ids"), joined("role_ids"))
    anonymous = F.col("tenant_id").isNull() & F.col("user_id").isNull()
    return F.sha2(F.when(anonymous, F.lit("anonymous")).otherwise(raw), 256)


def with_acl_class(chunks: DataFrame) -> DataFrame:
    """Adds ``acl_class``: the grant tokens as one string, empty when nobody may see the chunk."""
    return chunks.withColumn("acl_class", F.array_join(grants(), _SEPARATOR))


def class_tokens(acl_class: str) -> list[str]:
    """The grant tokens of an access class."""
    return acl_class.split(_SEPARATOR) if acl_class else []


def visible_classes(classes: DataFrame, principals: DataFrame) -> DataFrame:
    """(signature, acl_class) pairs that match; ``classes`` has acl_class in any multiplicity."""
    held = (principals.select(permission_signature().alias("signature"),
                              principal_tokens().alias("__tokens")).distinct()
            .select("signature", F.explode("__tokens").alias("token")))
    return opened_classes(classes, held)


def opened_classes(classes: DataFrame, held: DataFrame) -> DataFrame:
    """(signature, acl_class) pairs that share a token; ``held``: signature, token."""
    opened = (classes.select("acl_class").distinct().filter(F.col("acl_class") != "")
              .withColumn("token", F.explode(F.split("acl_class", _SEPARATOR))))
    return opened.join(held, "token").select("signature", "acl_class").distinct()


def visible_to(chunks: DataFrame, principals: DataFrame, principal_id: str = "user_id",
               chunk_id: str = "chunk_id", columns: Sequence[str] | None = None) -> DataFrame:
    """(principal, chunk) pairs the access rules allow, with the ``columns`` of the chunk (all by default).

    The principals and the chunks of a class are cut into bounded blocks, so the pairs
    are rectangles of two blocks, dealt out evenly however large a class is; they become rows at the very
    end. Neighbouring rows then repeat the same principals for one chunk after the other, which keeps
    what is written of them small.
    """
    columns = list(chunks.columns if columns is None else columns)
    classed = with_acl_class(chunks)
    rows = cut(classed.select("acl_class", F.xxhash64(chunk_id).alias("__hash"), F.struct(*columns).alias("__row")),
               "visible-chunks")
    people = principals.select(F.col(principal_id).alias("principal_id"),
                               permission_signature().alias("signature")).distinct()
    reach = cut(visible_classes(rows, principals).join(people, "signature").select(
        "acl_class", F.xxhash64("principal_id").alias("__hash"), "principal_id"), "visible-reach")
    nobody = F.array_repeat(F.lit(None).cast(reach.schema["principal_id"].dataType),
                            F.count_if(F.col("principal_id").isNull()).cast("int"))
    some = _blocks(reach, F.concat(F.sort_array(F.collect_list("principal_id")), nobody), PRINCIPAL_BLOCK, "__principals")
    of = _blocks(rows, F.collect_list("__row"), CHUNK_BLOCK, "__rows")
    met = of.join(some.withColumnRenamed("__block", "__other"), "acl_class")
    # few bytes make many rows, so their number of tasks is not left to AQE
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(tasks, "acl_class", "__block", "__other").select(F.explode("__rows").alias("__row"), "__principals")
    # this coalesce moves no row; it keeps generated code from holding all pairs of a rectangle at once
    return dealt.coalesce(tasks).select("__row.*", F.explode("__principals").alias("principal_id"))


def _blocks(rows: DataFrame, gather: Column, size: int, name: str) -> DataFrame:
    """acl_class, __block and the array ``gather`` of its rows: each class in blocks of ``size`` rows at most.
    Hashes deal out eight of them at once; all but the last are full, as repeats of whole bytes pack best."""
    dealt = F.ceil(F.count(F.lit(1)) / (8 * size)).alias("__parts")
    sized = rows.join(rows.groupBy("acl_class").agg(dealt), "acl_class")
    parts = sized.withColumn("__part", F.pmod("__hash", "__parts")).groupBy("acl_class", "__part").agg(gather.alias("__all"))
    first = F.sequence(F.lit(1), F.size("__all"), F.lit(size))
    cut_up = F.transform(first, lambda i: F.slice("__all", i, size))
    return parts.select("acl_class", "__part", F.posexplode(cut_up).alias("__n", name)).withColumn(
        "__block", F.struct("__part", "__n")).drop("__part", "__n")


def can_access(tenant_id: str, user_id: str | None, department_ids=(), role_ids=()) -> Column:
    """Access rule of one principal as a plain predicate, which Catalyst can push to the scan."""
    def among(column, values):
        return F.col(column).isin(*values) if values else F.lit(False)

    def overlaps(column, values):
        wanted = F.array(*[F.lit(v) for v in values])
        return F.arrays_overlap(F.col(column), wanted) if values else F.lit(False)

    own = F.col("owner_id") == user_id if user_id else F.lit(False)
    users = [user_id] if user_id else []
    rule = (F.when(F.col("visibility") == C.PRIVATE, own)
            .when(F.col("visibility") == C.DEPARTMENT, among("department_id", department_ids))
            .when(F.col("visibility").isin(C.TENANT, C.PUBLIC), F.lit(True))
            .when(F.col("visibility") == C.CUSTOM,
                  overlaps("allowed_user_ids", users) | overlaps("allowed_role_ids", role_ids)))
    return (F.col("tenant_id") == tenant_id) & F.coalesce(rule, F.lit(False))


def filter_live(chunks: DataFrame, tenant_id: str | None = None, status: str | None = C.ACTIVE,
                document_status: str | None = C.READY, version: int | None = None,
                visibility: str | None = None) -> DataFrame:
    """Equality filters; None leaves a column unfiltered. Missing states read as their defaults."""
    wanted = [("tenant_id", tenant_id, None), ("status", status, C.ACTIVE),
              ("document_status", document_status, C.READY), ("version", version, None),
              ("visibility", visibility, C.DEPARTMENT)]
    for column, value, default in wanted:
        if value is None:
            continue
        match = F.col(column) == value
        if default == value:
            match = match | F.col(column).isNull()
        chunks = chunks.filter(match)
    return chunks


def current_versions(documents: DataFrame) -> DataFrame:
    """Registry of READY documents and the version that counts."""
    return (documents.filter(F.col("status") == C.READY)
            .select("document_id", F.col("current_version").alias("version")))


def keep_current(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks whose (document, version) the registry names. AQE broadcasts a small registry and
    splits a hot document's chunks otherwise."""
    return chunks.join(registry, ["document_id", "version"], "left_semi")


def recheck_access(results: DataFrame, documents: DataFrame, principals: DataFrame) -> DataFrame:
    """Second pass over results, which carry ``principal_id`` and their chunk's columns: states,
    current version, both tenants and the access rule must hold now."""
    live = with_acl_class(filter_live(results))
    ready = (documents.filter(F.col("status") == C.READY)
             .select("document_id", F.col("current_version").alias("version"), "tenant_id"))
    current = live.join(ready, ["document_id", "version", "tenant_id"], "left_semi")
    people = principals.select(F.col("user_id").alias("principal_id"),
                               permission_signature().alias("signature")).distinct()
    allowed = (visible_classes(current, principals).join(people, "signature")
               .select("principal_id", "acl_class"))
    return current.join(allowed, ["principal_id", "acl_class"], "left_semi").drop("acl_class")


def check_threshold(threshold: float) -> None:
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must be between -1 and 1")


def apply_threshold(df: DataFrame, threshold: float, include_below: bool = False) -> DataFrame:
    """Adds ``included`` and ``debug_info``; rows below the threshold go unless asked for."""
    check_threshold(threshold)
    reached = F.col("score") >= threshold
    reason = F.when(reached, F.lit("score >= threshold")).otherwise(F.lit("score < threshold"))
    marked = df.withColumn("included", reached).withColumn("debug_info", reason)
    return marked if include_below else marked.filter("included")


def allowed_tools(principals: DataFrame, tools: DataFrame, policy: DataFrame) -> DataFrame:
    """Tools each principal may see: permission held, tool enabled, tenant and role allowed.

    ``principals``: tenant_id, user_id, role_ids, permissions; ``tools``: tool_name,
    permission_code; ``policy``: tool_name, enabled, allowed_tenant_ids, allowed_role_ids. Joined
    on the permission code, not crossed.
    """
    held = principals.withColumn("permission_code", F.explode("permissions"))
    rules = policy.select("tool_name", "enabled", "allowed_tenant_ids", "allowed_role_ids")
    named = tools.select("tool_name", "permission_code").join(rules, "tool_name", "left")
    tenants, roles = _strings(F.col("allowed_tenant_ids")), _strings(F.col("allowed_role_ids"))
    visible = (F.coalesce("enabled", F.lit(True))
               & ((F.size(tenants) == 0) | F.array_contains(tenants, F.col("tenant_id")))
               & ((F.size(roles) == 0) | F.arrays_overlap(roles, _strings(F.col("role_ids")))))
    return (held.join(named, "permission_code").filter(visible)
            .select("tenant_id", "user_id", "tool_name").distinct())

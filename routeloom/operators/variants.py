"""JSON and GraphQL bodies as schemas inside the JVM (I5-I8, I11, N1): no Python worker, no shuffle.

A body is parsed to a VARIANT, its tree is unfolded level by level by one ``aggregate`` over the
possible depth (a no-op once no container is left), and the texts of the nodes, sorted by their
position, are joined to the schema. Work is linear in the nodes but for one sort.

Bodies that are not JSON are left to ``infer``. A text that Spark's parser refuses although it is JSON (a name twice in one object, more than 1000
levels, a body that holds the end mark) gives null, as does text that is no JSON.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import content

END = "routeloom.end"
MARK = "\u0001"  # before each leaf's text; JSON texts hold no bare control characters
OPEN = "array<struct<at: string, path: string, lead: string, inside: boolean, vs: array<variant>>>"
DONE = "array<struct<at: string, path: string, lead: string, inside: boolean, leaf: boolean, head: string, tail: string>>"
PARTS = "struct<schema: string, fields: array<struct<field_path: string, type_json: string>>, names: array<string>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f over a value that is evaluated once for the row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def entries(v: Column) -> Column:
    """Names and values of an object, null for anything else."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def quoted(name: Column) -> Column:
    one = F.to_json(F.array(name))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def document(body: Column) -> Column:
    """The whole body as one VARIANT; null if it is no JSON value, has text behind it or a number beyond doubles.

    Spark's parser stops after the first value, so the body is parsed as a member before a mark.
    """
    infinite = lambda s: F.size(F.split(s, "Infinity"))

    def held(text: Column, doc: Column) -> Column:
        huge = text.rlike(r"[0-9][eE]\+?[0-9]{3}|[0-9]{309}") & (infinite(F.to_json(doc)) > infinite(text))
        return let(entries(doc), lambda e: F.when((F.size(e) == 2) & (F.get(e, F.lit(0)).key == END) & (F.get(e, F.lit(1)).key == "v") & ~huge, F.get(e, F.lit(1)).value))

    wrapped = lambda text: F.when(~text.contains(END), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(f',"{END}":0}}'))))
    return let(F.make_valid_utf8(body.cast("string")), lambda text: let(wrapped(text), lambda doc: held(text, doc)))


def scalar(v: Column) -> Column:
    """Schema text of null, boolean, number and string."""
    text = lambda s: let(content.string_format(s), lambda f: F.when(f == "", '{"type":"string"}').otherwise(F.concat(F.lit('{"type":"string","format":"'), f, F.lit('"}'))))
    number = let(F.try_variant_get(v, "$", "double"), lambda x: F.when(x == F.rint(x), '{"type":"integer"}').otherwise('{"type":"number"}'))
    of = lambda kind: F.when(kind == "STRING", let(F.try_variant_get(v, "$", "string"), text)).when(kind == "BOOLEAN", '{"type":"boolean"}').when(kind == "VOID", '{"nullable":true}').otherwise(number)
    return let(F.schema_of_variant(v), of)


def place(i: Column) -> Column:
    """A child's number behind its parent's place: ten digits, so that places sort as the document goes."""
    return F.lpad(i.cast("string"), 10, "0")


def opened(n: Column) -> Column:
    """One node: its own texts and its children. Several values are the objects of one array, united."""
    none = F.array().cast(OPEN)

    def node(leaf: bool, head: Column | str, tail: Column | str, kids: Column) -> Column:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(n.at.alias("at"), n.path.alias("path"), n.lead.alias("lead"), n.inside.alias("inside"), (F.lit(leaf) & ~n.inside).alias("leaf"), text(head).alias("head"), text(tail).alias("tail"), kids.alias("kids"))

    def child(name: Column, m: Column, v: Column) -> Column:
        path = F.when(n.path == "", name).otherwise(F.concat(n.path, F.lit("."), name))
        return F.struct(F.concat(n.at, place(m)).alias("at"), path.alias("path"), F.concat(F.when(m > 0, ",").otherwise(""), quoted(name), F.lit(":")).alias("lead"), n.inside.alias("inside"), F.array(v).alias("vs"))

    def filled(names: Column, kids: Column) -> Column:
        tail = F.when(F.size(names) == 0, "}}").otherwise(F.concat(F.lit('},"required":'), F.to_json(names), F.lit("}")))
        return node(False, '{"type":"object","properties":{', tail, kids)

    def single(held: Column) -> Column:
        refs = F.array_sort(F.transform(held, lambda x, p: F.struct(x.key.alias("k"), p.alias("p"))))
        return let(refs, lambda r: filled(r.k, F.transform(r, lambda x, m: child(x.k, m, F.get(held, x.p).value))))

    def united(held: Column) -> Column:
        refs = F.flatten(F.transform(held, lambda e, i: F.transform(e, lambda x, p: F.struct(x.key.alias("k"), i.alias("i"), p.alias("p")))))
        first = lambda r: F.filter(F.transform(r, lambda x, j: F.struct(x.k.alias("k"), x.i.alias("i"), x.p.alias("p"), j.alias("j"), ((j == 0) | (x.k != F.get(r, j - 1).k)).alias("first"))), lambda x: x.first)
        return let(F.array_sort(refs), lambda r: let(first(r), lambda firsts: members(held, firsts, F.size(r))))

    def members(held: Column, firsts: Column, total: Column) -> Column:
        span = F.transform(firsts, lambda f, m: F.struct(f.k.alias("k"), (F.coalesce(F.get(firsts, m + 1).j, total) - f.j).alias("n")))
        need = F.filter(span, lambda x: x.n == F.size(held)).k
        kids = F.transform(firsts, lambda f, m: child(f.k, m, F.get(F.get(held, f.i), f.p).value))
        return F.when(F.size(firsts) == 0, node(True, '{"type":"object"}', "", none)).otherwise(let(need, lambda names: filled(names, kids)))

    def listed(items: Column) -> Column:
        same = F.forall(items, lambda x: entries(x).isNotNull())
        kid = F.struct(F.concat(n.at, place(F.lit(0))).alias("at"), n.path.alias("path"), F.lit("").alias("lead"), F.lit(True).alias("inside"), F.when(same, items).otherwise(F.slice(items, 1, 1)).alias("vs"))
        return F.when(F.size(items) == 0, node(True, '{"type":"array","items":{"type":"object"}}', "", none)).otherwise(node(True, '{"type":"array","items":', "}", F.array(kid)))

    def other(v: Column) -> Column:
        return let(F.try_variant_get(v, "$", "array<variant>"), lambda items: F.when(items.isNotNull(), listed(items)).otherwise(node(True, scalar(v), "", none)))

    def one(v: Column) -> Column:
        return let(entries(v), lambda e: F.when(F.size(e) > 0, single(e)).when(e.isNotNull(), node(True, '{"type":"object"}', "", none)).otherwise(other(v)))

    return F.when(F.size(n.vs) == 1, one(F.get(n.vs, F.lit(0)))).otherwise(let(F.transform(n.vs, entries), united))


def nodes(root: Column, path: Column, depth: Column) -> Column:
    """All nodes of a VARIANT by level."""
    first = F.array(F.struct(F.lit("").alias("at"), path.alias("path"), F.lit("").alias("lead"), F.lit(False).alias("inside"), F.array(root).alias("vs"))).cast(OPEN)
    start = F.struct(first.alias("open"), F.array().cast(DONE).alias("done"))

    def step(s: Column, _: Column) -> Column:
        return F.when(F.size(s.open) == 0, s).otherwise(let(F.transform(s.open, opened), lambda o: F.struct(
            F.flatten(o.kids).alias("open"),
            F.concat(s.done, F.transform(o, lambda x: F.struct(x.at.alias("at"), x.path.alias("path"), x.lead.alias("lead"), x.inside.alias("inside"), x.leaf.alias("leaf"), x["head"].alias("head"), x.tail.alias("tail")))).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), depth), start, step, lambda s: s.done)


def joined(done: Column, head: Callable[[Column], Column]) -> Column:
    """Texts of nodes in the order of the document."""
    start = lambda d: F.struct(d.at.alias("at"), head(d).alias("t"))
    end = lambda d: F.struct(F.concat(d.at, F.lit("x")).alias("at"), d.tail.alias("t"))
    texts = F.flatten(F.transform(done, lambda d: F.when(d.tail == "", F.array(start(d))).otherwise(F.array(start(d), end(d)))))
    return F.array_join(F.array_sort(texts).t, "")


def leaves(done: Column) -> Column:
    """(dotted path, type) of the leaves in order; arrays are leaves, a leaf without a path goes."""
    text = joined(F.filter(done, lambda d: d.inside | d.leaf), lambda d: F.when(d.leaf, F.concat(F.lit(MARK), d["head"])).otherwise(F.concat(d.lead, d["head"])))
    ends = F.transform(F.array_sort(F.transform(F.filter(done, lambda d: d.leaf), lambda d: F.struct(d.at.alias("at"), d.path.alias("path")))), lambda x: x.path)
    both = let(F.split(text, MARK), lambda ts: F.transform(ends, lambda p, i: F.struct(p.alias("field_path"), F.get(ts, i + 1).alias("type_json"))))
    return F.filter(both, lambda x: x.field_path != "")


def parts(body: Column, graph: Column) -> Column:
    """Schema text, leaves and top-level names of a JSON body; where graph, a GraphQL body (I11) if it is an object."""
    levels = F.length(F.regexp_replace(body.cast("string"), r"[^{\[]+", "")) + 1

    def of(doc: Column) -> Column:
        asks = graph & entries(doc).isNotNull()
        query = F.try_variant_get(doc, "$.query", "variant")
        op = F.when(F.schema_of_variant(query) == "STRING", content.graphql_operation(F.try_variant_get(query, "$", "string"))).otherwise("graphql")
        variables = F.try_variant_get(doc, "$.variables", "variant")
        bare = F.concat(F.lit('{"type":"object","description":"'), op, F.lit('"'))
        lone = F.struct(F.concat(bare, F.lit("}")).alias("schema"), F.array().cast("array<struct<field_path: string, type_json: string>>").alias("fields"), F.array().cast("array<string>").alias("names")).cast(PARTS)
        plain = lambda root, path: let(nodes(root, F.lit(path), F.least(levels, F.lit(1001))), lambda done: F.struct(
            joined(done, lambda d: F.concat(d.lead, d["head"])).alias("schema"), leaves(done).alias("fields"),
            F.transform(F.filter(done, lambda d: (F.length(d.at) == 10) & ~d.inside), lambda d: d.path).alias("names")).cast(PARTS))
        held = let(plain(variables, "variables"), lambda x: F.struct(
            F.concat(bare, F.lit(',"properties":{"variables":'), x.schema, F.lit("}}")).alias("schema"), x.fields.alias("fields"), F.array(F.lit("variables")).alias("names")).cast(PARTS))
        there = variables.isNotNull() & ~F.is_variant_null(variables)
        return F.when(asks & there, held).when(asks, lone).otherwise(plain(doc, ""))

    return let(document(body), lambda doc: F.when(doc.isNotNull(), of(doc)))


def described(schema: Column) -> Column:
    """Whether a schema is that of a GraphQL or gRPC body: only these have a description first."""
    return schema.startswith('{"type":"object","description":"')


def answered(schema: Column) -> Column:
    """The schema of an answer to a GraphQL request."""
    anew = F.regexp_replace(schema, r'\A(\{"type":"object","description":")[a-z]+', "$1graphql")
    return F.when(described(schema), anew).otherwise(F.concat(F.substring(schema, F.lit(1), F.length(schema) - 1), F.lit(',"description":"graphql"}')))


def side(kind: Column, body: Column, request: bool) -> Column:
    """Schema, leaves and names of one side of a pair; null for XML and forms, empty bodies and refused texts."""
    asks = (kind == "graphql") | (F.lit(request) & (kind == "json") & body.contains(F.lit(b'"query"')))
    found = let(parts(body, F.coalesce(asks, F.lit(False))), lambda x: F.when((kind != "graphql") | described(x.schema), x))
    fixed = F.struct(F.when(kind == "grpc", '{"type":"object","description":"grpc"}').otherwise('{"type":"object"}'), F.array().cast("array<struct<field_path: string, type_json: string>>"), F.array().cast("array<string>")).cast(PARTS)
    return F.when(F.octet_length(body) > 0, F.when(kind.isin("json", "graphql"), found).when(kind.isin("multipart", "grpc"), fixed))


def inferred(pairs: DataFrame) -> DataFrame:
    """Adds ``req`` and ``resp`` (schema, fields, names) to rows with ``req_kind``, ``req_body``, ``resp_kind``, ``resp_body``."""
    out = pairs.withColumns({"req": side(F.col("req_kind"), F.col("req_body"), True), "resp": side(F.col("resp_kind"), F.col("resp_body"), False)})
    graph = (F.col("req_kind") == "json") & F.col("req_body").contains(F.lit(b'"query"')) & described(F.col("req.schema")) & F.col("resp.schema").isNotNull()
    return out.withColumn("resp", F.when(graph, F.col("resp").withField("schema", answered(F.col("resp.schema")))).otherwise(F.col("resp")))

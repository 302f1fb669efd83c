"""The domain registry: types, relations between them, and what a claim says about a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidora.functions.text import fold

#: Subtypes and their types; fixed values.
TYPE_PARENTS = {"Estado": "Territorio", "Municipio": "Territorio", "Região": "Territorio"}
#: Relations with the types they may start and end at; fixed values.
RELATIONS = {
    "OBSERVACAO_DE": (("ObservacaoEstatistica",), ("Indicador",)),
    "REFERENTE_A": (("ObservacaoEstatistica", "Comparacao"), ("Período",)),
    "APLICA_SE_A": (("ObservacaoEstatistica", "Comparacao"), ("Territorio",)),
    "NO_SETOR": (("ObservacaoEstatistica",), ("Setor",)),
    "EXPRESSA_EM": (("ObservacaoEstatistica",), ("Unidade",)),
    "MEDIDO_POR": (("ObservacaoEstatistica", "Indicador"), ("FonteDados",)),
    "SUSTENTADA_POR": (("ObservacaoEstatistica", "Comparacao", "OperandoCalculo"), ("Chunk",)),
    "BASE_DE": (("ObservacaoEstatistica", "OperandoCalculo"), ("Comparacao",)),
    "FINAL_DE": (("ObservacaoEstatistica", "OperandoCalculo"), ("Comparacao",)),
    "OPERANDO_DE": (("OperandoCalculo",), ("Comparacao",)),
    "BASEADO_EM": (("OperandoCalculo",), ("ObservacaoEstatistica",)),
    "CRESCEU_EM": (("Indicador",), ("Período",)),
    "RECUOU_EM": (("Indicador",), ("Período",)),
    "RELACIONA_COM": (("Indicador", "Setor"), ("Indicador", "Setor")),
    "ASSOCIADO_A": (("Indicador",), ("Indicador",)),
    "CAUSA": (("Indicador",), ("Indicador",)),
    "CONTIDA_EM": (("Chunk", "Tabela", "Grafico"), ("Pagina",)),
    "PERTENCE_A_DOC": (("Pagina",), ("Documento",)),
    "DESCRITA_EM": (("Tabela", "Grafico"), ("Chunk",)),
    "TEM_TITULO": (("Tabela", "Grafico", "Chunk"), ("Chunk",)),
    "TEM_NOTA": (("Tabela", "Grafico", "Chunk"), ("Chunk",)),
    "REPRESENTADA_EM": (("Tabela", "Grafico"), ("Chunk",)),
    "NEXT_CHUNK": (("Chunk",), ("Chunk",)),
    "SAME_PAGE": (("Chunk",), ("Chunk",)),
}
#: Both ends of a part must be of the same family.
FAMILIES = ("Territorio", "Setor")
#: What a text says about a relation, on folded text; fixed values.
NOT_NEGATION = r"\bnao\s+(?:so|apenas|somente)\b"
NEGATION = r"\b(?:nao|nunca|jamais)\b|\bsem\s+(?:crescimento|aumento|reducao|queda|correlacao|associacao|efeito|impacto)\b"
CAUSE = r"\b(?:causou|causa|causar|provocou|provoca|provocar|levou a|resultou em|em decorrencia de|devido a)\b"
ASSOCIATION = r"\b(?:correlacao|associacao|associad[oa]s?|correlacionad[oa]s?)\b"
GREW = r"\b(?:cresceu|crescimento|aumentou|aumento|avancou|alta)\b"
FELL = r"\b(?:recuou|recuo|diminuiu|queda|caiu|reducao)\b"
UNCERTAIN = r"\b(?:pode|podem|poderia|talvez|possivel|provavel|estima|estimado|projecao)\b"
CONDITION = r"(?<![-\w])se\b|\bcaso\b"


def valid_relations(triples: DataFrame) -> DataFrame:
    """Adds `valid`: whether (subject_type, relation, object_type) keeps to the relation's types or their subtypes."""
    spark = triples.sparkSession
    kinds = {t for pair in RELATIONS.values() for side in pair for t in side} | set(TYPE_PARENTS) | set(FAMILIES)
    closure = spark.createDataFrame([(t, t) for t in sorted(kinds)] + sorted(TYPE_PARENTS.items()), "kind string, of string")
    rules = [(r, a, b) for r, (x, y) in RELATIONS.items() for a in x for b in y] + [("PARTE_DE", f, f) for f in FAMILIES]
    rule = spark.createDataFrame(rules, "relation string, a string, b string")
    allowed = rule.join(closure.select(F.col("kind").alias("subject_type"), F.col("of").alias("a")), "a").join(closure.select(F.col("kind").alias("object_type"), F.col("of").alias("b")), "b")
    allowed = allowed.select("subject_type", "relation", "object_type").distinct().withColumn("valid", F.lit(True))
    return triples.join(allowed, ["subject_type", "relation", "object_type"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def relation_attributes(relation: Column, evidence: Column) -> Column:
    """Struct (polarity, kind, modality, refused) of what the evidence says about a relation.

    "Not only" affirms.  refused names what a causal, associative, growing or falling relation lacks in its evidence.
    """
    t = fold(evidence)
    negated = F.regexp_replace(t, NOT_NEGATION, "").rlike(NEGATION)
    causal, association = t.rlike(CAUSE), t.rlike(ASSOCIATION)
    refused = (
        F.when((relation == "CAUSA") & (~causal | association), "no_cause").when((relation == "ASSOCIADO_A") & ~association, "no_association")
        .when((relation == "CRESCEU_EM") & ~t.rlike(GREW), "no_growth").when((relation == "RECUOU_EM") & ~t.rlike(FELL), "no_fall")
    )
    return F.struct(
        F.when(negated, "negated").otherwise("affirmed").alias("polarity"),
        F.when(relation == "CAUSA", "causal_claim").when(relation.isin("ASSOCIADO_A", "RELACIONA_COM"), "association").otherwise("typed_relation").alias("kind"),
        F.when(t.rlike(CONDITION), "conditional").when(t.rlike(UNCERTAIN), "uncertain").otherwise("asserted").alias("modality"),
        refused.alias("refused"),
    )


def checked_triples(responses: DataFrame, nodes: DataFrame, most: int = 6, least_evidence: int = 8) -> DataFrame:
    """(node_id, position, subject, relation, object, rejected) of recorded model responses (node_id, response).

    A response is the JSON object between its first and last brace.  Rejected, in this order: limit, evidence_length,
    evidence_not_literal, names_not_in_evidence.  Responses that do not parse give no row.
    """
    schema = "triples array<struct<subject:struct<name:string,type:string>,relation:string,object:struct<name:string,type:string>,evidence:string>>"
    body = F.regexp_extract("response", r"(?s)(\{.*\})", 1)
    rows = responses.select("node_id", F.posexplode(F.from_json(body, schema)["triples"]).alias("at", "t")).join(nodes.select("node_id", "text"), "node_id")
    e = F.trim(F.coalesce(F.col("t.evidence"), F.lit("")))
    named = F.contains(e, F.coalesce(F.col("t.subject.name"), F.lit("\u0000"))) & F.contains(e, F.coalesce(F.col("t.object.name"), F.lit("\u0000")))
    why = F.when(F.col("at") >= most, "limit").when(F.length(e) < least_evidence, "evidence_length").when(~F.contains(F.coalesce("text", F.lit("")), e), "evidence_not_literal").when(~named, "names_not_in_evidence")
    return rows.select("node_id", F.col("at").alias("position"), F.col("t.subject.name").alias("subject"), F.col("t.relation").alias("relation"), F.col("t.object.name").alias("object"), why.alias("rejected"))


def round_robin(rows: DataFrame, groups: list[str], order: list[str], k: int) -> DataFrame:
    """k rows taken from the groups in turn: a sampling operator."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", *groups).limit(k)


def keyword_scores(texts: DataFrame, skills: DataFrame, id_col: str, text_col: str, k: int = 2) -> DataFrame:
    """(id, skill, score, position): skills (skill, keyword, priority) whose keywords stand in a text as whole words.

    A keyword gives one point and one for each blank in it.  Keywords are a small table of the domain.
    """
    said = texts.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), F.regexp_replace(fold(F.col(text_col)), r"[^a-z0-9]+", " "), F.lit(" ")).alias("t"))
    known = skills.groupBy().agg(F.collect_list(F.struct("skill", "keyword", "priority")).alias("all"))
    met = said.crossJoin(F.broadcast(known)).select("id", F.explode(F.filter("all", lambda x: F.contains(F.col("t"), F.concat(F.lit(" "), x["keyword"], F.lit(" "))))).alias("x"))
    points = met.groupBy("id", "x.skill", "x.priority").agg(F.sum(1 + F.length("x.keyword") - F.length(F.replace("x.keyword", F.lit(" "), F.lit("")))).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("priority"), "skill")
    return points.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select("id", "skill", "score", "position")


def canonical_entities(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds `entity`: the id of the only registered entity (id, type, pattern) of the same type whose pattern occurs in the name, else
    the name itself.  The registry is a small table of the domain, sent to all tasks only while Spark finds it small."""
    n, r = names.select("name", "type").distinct().alias("n"), registry.alias("r")
    met = n.join(r, F.col("n.type") == F.col("r.type")).where(F.expr("regexp_like(translate(lower(n.name), 'áàâãäéêèëíìîïóôõòöúùûüç', 'aaaaaeeeeiiiiooooouuuuc'), r.pattern)"))
    one = met.groupBy("n.name", "n.type").agg(F.min("r.id").alias("entity"), F.count("*").alias("k")).where("k = 1").drop("k")
    return names.join(one, ["name", "type"], "left").withColumn("entity", F.coalesce("entity", "name"))


def extension_problems(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """(id, problem) of proposed entries (id, label, pattern, parent) of the vocabulary; null problems are fine.

    In this order: id (form, or repeated in proposals or known), label, pattern (missing, or not folded), parent (not known or proposed).
    """
    ids = known.select("id").distinct().withColumn("registered", F.lit(True))
    often = proposed.groupBy("id").agg(F.count("*").alias("times"))
    parents = known.select("id").union(proposed.select("id")).distinct().select(F.col("id").alias("parent"), F.lit(True).alias("parent_known"))
    j = proposed.join(ids, "id", "left").join(often, "id", "left").join(parents, "parent", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    bad_id = ~F.coalesce(F.col("id").rlike(r"^[a-z][a-z0-9_]{1,59}$"), F.lit(False)) | F.col("registered").isNotNull() | (F.col("times") > 1)
    why = F.when(bad_id, "id").when(blank("label"), "label").when(blank("pattern") | (fold(F.col("pattern")) != F.col("pattern")), "pattern").when(F.col("parent").isNotNull() & F.col("parent_known").isNull(), "parent")
    return j.select("id", why.alias("problem"))

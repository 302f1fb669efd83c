"""What a question asks for: its scope, the routes it takes, and what must be clarified; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidora.functions.facets import DIMENSIONS, VOCABULARY
from evidora.functions.text import fold, fold_compatible

#: (id, name, type, parent) of the registered territories; fixed values.
TERRITORIES = (
    ("brasil", "Brasil", "Territorio", None),
    ("estado_sp", "Estado de São Paulo", "Estado", "brasil"),
    ("municipio_sp", "Município de São Paulo", "Municipio", "estado_sp"),
    ("rmsp", "Região Metropolitana de São Paulo", "Região", "estado_sp"),
    ("interior_sp", "Interior paulista", "Região", "estado_sp"),
)
#: Labels of the indicators and sectors; fixed values.
INDICATOR_LABELS = {
    "desocupacao": "Taxa de desocupação",
    "ocupacao": "Ocupação",
    "pib": "Produto interno bruto",
    "exportacao": "Exportações",
    "importacao": "Importações",
    "saldo": "Saldo",
    "rendimento": "Rendimento",
    "producao": "Produção",
    "emprego": "Emprego",
    "inflacao": "Inflação",
    "participacao": "Participação",
}
SECTOR_LABELS = {
    "industria": "Indústria",
    "comercio": "Comércio",
    "servicos": "Serviços",
    "agropecuaria": "Agropecuária",
    "construcao": "Construção",
    "industria_transformacao": "Indústria de transformação",
    "industria_extrativa": "Indústria extrativa",
}
SECTOR_PARENTS = {"industria_transformacao": "industria", "industria_extrativa": "industria"}
#: Patterns on folded questions; fixed values.
BARE_NAME = r"sao paulo|\bsp\b|paulista"
STATE_SERIES = r"\b(?:pib|produto interno bruto)(?:\s+mensal|\s+trimestral)?\s+paulista\b"
PIB = r"\bpib\b|produto interno bruto"
PIB_CONCEPT = r"\bo que (?:e|significa)\b|\b(?:definicao|conceito|metodologia|como|por que|fonte|fontes|formula|ponderacao|otica|ano.base|periodo de referencia|unidade de medida)\b"
PIB_POINT = r"\b(?:qual|quanto|valor|informe|mostre|consulte)\b"
STRUCTURED = r"cnae|ibge|municip|cadastro|classifica|planilha|\bcelula\b|\bpib\b|produto interno bruto"
DEFINITIONAL = r"\b(defin\w*|signific\w*|dicionario|variaveis|variavel|conceit\w*|hierarq\w*|nomenclatura|classific\w*|regionaliza\w*)\b"
RATE = r"\b(?:qual|quanto)\b.*\b(?:variacao|crescimento|taxa)\b"
YEAR = r"\b(?:19|20)[0-9]{2}\b"
SEQUENCE = r"\b(?:evolucao|trajetoria|tendencia|serie|series|grafico|calcule|calcular|calculo)\b|ao longo|a partir|com base"
CORPUS = r"\b(corpus|documentos|boletins|base de dados|colecao|conjunto de dados)\b"
OVERVIEW = r"\b(temas|panorama|visao geral|resum\w*|sintese|principais tendencias|relacoes economicas)\b"
SOURCES = (
    r"\b(?:qual|quais|liste|mostre|informe|indique)\s+(?:(?:foi|foram|e|sao)\s+)?(?:a\s+|as\s+|o\s+|os\s+)?(?:fontes?|referencias?|documentos?|arquivos?|pdfs?)\b",
    r"\bde onde (?:veio|vem|saiu|foi retirada|foi obtida)\b",
    r"\bonde (?:isso|essa informacao|esse dado|essa afirmacao) (?:consta|aparece|esta)\b",
    r"\borigem (?:da|dessa) informacao\b",
)
RECENT = r"\b(?:19|20)[0-9]{2}\b|mais recente|ultimo (?:ano|periodo|dado)|ultima divulgacao"
ASKS_RATE, GROWTH, SERVICES = r"\b(?:qual|quanto|informe|mostre)\b", r"\b(?:crescimento|variacao|taxa|variou|cresceu)\b", r"\bservicos\b"
NEAR_PERIOD, CONCEPT = r"\b(?:19|20)[0-9]{2}\b|\b(?:ontem|hoje|ultimo|ultima|recente)\b", r"\b(?:significa|conceito|definicao|metodologia|fonte|fontes)\b"
MANY_PLACES, MANY_TOWNS, MANY_REGIONS, MANY_SECTORS = r"\b(?:municipios|cidades|regioes|territorios)\b", r"\b(?:municipios|cidades)\b", r"\bregioes\b", r"\b(?:subsetores|ramos|atividades|segmentos)\b"


def ambiguous_territory(folded: Column) -> Column:
    """Whether a bare name of the state or city stands outside all registered territories of the text."""
    rest = folded
    for d, _, p in VOCABULARY:
        if d == "region":
            rest = F.regexp_replace(rest, p, " # ")
    return rest.rlike(BARE_NAME)


def constraints(question: Column, dims: Column) -> Column:
    """Struct (region, ambiguous): the territories a question names; the state's own series settles its adjective."""
    t = fold(question)
    state = t.rlike(STATE_SERIES) & (F.size(dims["region"]) == 0)
    return F.struct(F.when(state, F.array(F.lit("estado_sp"))).otherwise(dims["region"]).alias("region"), (ambiguous_territory(t) & ~state).alias("ambiguous"))


def preserved(before: Column, after: Column) -> Column:
    """Whether a rewritten question keeps every scope of the original but the source."""
    same = F.lit(True)
    for d in DIMENSIONS:
        if d != "source":
            same = same & before[d].eqNullSafe(after[d])
    return same


def _below(parents: dict[str, str | None]) -> dict[str, list[str]]:
    children: dict[str, list[str]] = {}
    for child, parent in parents.items():
        children.setdefault(parent or "", []).append(child)

    def all_of(x: str) -> list[str]:
        return [z for y in children.get(x, []) for z in [y, *all_of(y)]]

    return {x: all_of(x) for x in parents}


def _one_of(ids: Column, table: dict[str, list[str]]) -> Column:
    maps = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*(F.lit(y) for y in v)).cast("array<string>")))) if table else None
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ids, lambda x: F.coalesce(maps[x], F.array().cast("array<string>"))))))


def hierarchy_scope(question: Column, dims: Column) -> Column:
    """Struct (region, region_asked, sector, sector_asked): what lies below the named territories or sectors if a question asks for
    several; towns or regions alone if it says so."""
    t = fold(question)
    places = (F.size(dims["region"]) > 0) & t.rlike(MANY_PLACES)
    parts = (F.size(dims["sector"]) > 0) & t.rlike(MANY_SECTORS)
    below = _below({i: p for i, _, _, p in TERRITORIES})
    kind = {i: k for i, _, k, _ in TERRITORIES}
    only = lambda want: {i: [x for x in v if kind[x] == want] for i, v in below.items()}
    region = F.when(t.rlike(MANY_TOWNS), _one_of(dims["region"], only("Municipio"))).when(t.rlike(MANY_REGIONS), _one_of(dims["region"], only("Região"))).otherwise(_one_of(dims["region"], below))
    sector = _one_of(dims["sector"], {p: [c for c, q in SECTOR_PARENTS.items() if q == p] for p in set(SECTOR_PARENTS.values())})
    none = F.array().cast("array<string>")
    return F.struct(F.when(places, region).otherwise(none).alias("region"), places.alias("region_asked"), F.when(parts, sector).otherwise(none).alias("sector"), parts.alias("sector_asked"))


def expanded(question: Column, dims: Column, most: int = 4) -> Column:
    """The question with up to `most` labels of what it names and does not spell out."""
    t = fold(question)
    labels = [("indicator", i, x) for i, x in INDICATOR_LABELS.items()] + [("region", i, x) for i, x, _, _ in TERRITORIES]
    new = F.array_compact(F.array(*(F.when(F.array_contains(dims[d], i) & ~F.contains(t, fold(F.lit(x))), F.lit(x)) for d, i, x in labels)))
    return F.when(F.size(new) > 0, F.concat(question, F.lit("\nTermos equivalentes para busca: "), F.array_join(F.slice(new, 1, most), "; "))).otherwise(question)


def routes(question: Column) -> Column:
    """Struct of the routes of a question: value, structured, definitional, point, overview, sources."""
    t = fold_compatible(question)
    every = lambda *ps: [t.rlike(p) for p in ps]
    pib, concept, point = every(PIB, PIB_CONCEPT, PIB_POINT)
    rate, year, sequence, corpus, overview = every(RATE, YEAR, SEQUENCE, CORPUS, OVERVIEW)
    asked = [fold(question).rlike(p) for p in SOURCES]
    sources = asked[0]
    for a in asked[1:]:
        sources = sources | a
    return F.struct(
        (pib & point & ~concept).alias("value"), t.rlike(STRUCTURED).alias("structured"), t.rlike(DEFINITIONAL).alias("definitional"),
        (rate & year & ~sequence).alias("point"), (corpus & overview).alias("overview"), sources.alias("sources"),
    )


def clarification(question: Column, dims: Column) -> Column:
    """What must be asked back: services_scope, region, period, or null."""
    t = fold_compatible(question)
    services = t.rlike(ASKS_RATE) & t.rlike(GROWTH) & t.rlike(SERVICES) & ~t.rlike(NEAR_PERIOD) & ~t.rlike(CONCEPT)
    region = constraints(question, dims)["ambiguous"] & (F.size(dims["indicator"]) > 0)
    period = routes(question)["value"] & ~t.rlike(RECENT)
    return F.when(services, "services_scope").when(region, "region").when(period, "period")

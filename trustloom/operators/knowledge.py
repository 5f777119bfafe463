"""Concept records -> triples, property-graph tables and audits.

The mapping is a table (one row per predicate), given as an argument. Predicates
are prefixed names; the prefixes and the base of all subjects are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions.hof import let
from trustloom.functions.local import local_table

RDF_TYPE = "rdf:type"
LABEL = "rdfs:label"

# Concept | subject | class | predicate | kind of object | object.
CONCEPT_MAPPING = """
Organization | Organization/{identifier} | org:Organization | dct:identifier | reference | identifier
Person | Person/{givenName}_{lastName} | foaf:Person | foaf:givenName | reference | givenName
Person | Person/{givenName}_{lastName} | foaf:Person | foaf:lastName | reference | lastName
Membership | Membership/{identifier} | org:Membership | dct:identifier | reference | identifier
Membership | Membership/{identifier} | org:Membership | org:member | template | Person/{member}
Membership | Membership/{identifier} | org:Membership | org:role | template | Role/{role}
Membership | Membership/{identifier} | org:Membership | org:organization | template | Organization/{organization}
Role | Role/{identifier} | org:Role | dct:identifier | reference | identifier
Role | Role/{identifier} | org:Role | kg:follows | template | Policy/{follows}
User | User/{identifier} | kg:User | dct:identifier | reference | identifier
User | User/{identifier} | kg:User | kg:request | reference | request
User | User/{identifier} | kg:User | kg:manages | template | Intent/{manages}
User | User/{identifier} | kg:User | kg:belongsTo | template | AdministrativeDomain/{belongsTo}
User | User/{identifier} | kg:User | kg:signs | template | TrustLevelAgreement/{signs}
User | User/{identifier} | kg:User | kg:entityType | template | DigitalServiceEntity/{entityType}
User | User/{identifier} | kg:User | rdfs:subClassOf | constant | kg:Person
Reward | Reward/{value} | kg:value | kg:value | reference | value
Punishment | Punishment/{value} | kg:Punishment | kg:value | reference | value
Punishment | Punishment/{value} | kg:Punishment | kg:punishmentAction | template | PunishmentAction/{punishmentAction}
LevelOfTrust | LevelOfTrust/{trustor}_{trustee} | kg:LevelOfTrust | kg:trustor | reference | trustor
LevelOfTrust | LevelOfTrust/{trustor}_{trustee} | kg:LevelOfTrust | kg:trustee | reference | trustee
LevelOfTrust | LevelOfTrust/{trustor}_{trustee} | kg:LevelOfTrust | kg:lot | reference | lot
LevelOfTrust | LevelOfTrust/{trustor}_{trustee} | kg:LevelOfTrust | kg:startTime | reference | startTime
LevelOfTrust | LevelOfTrust/{trustor}_{trustee} | kg:LevelOfTrust | kg:stopTime | reference | stopTime
LevelOfTrust | LevelOfTrust/{trustor}_{trustee} | kg:LevelOfTrust | kg:enforces | template | Punishment/{enforces}
LevelOfTrust | LevelOfTrust/{trustor}_{trustee} | kg:LevelOfTrust | kg:applies | template | Reward/{applies}
LevelOfTrust | LevelOfTrust/{trustor}_{trustee} | kg:LevelOfTrust | kg:gathers | template | Indicator/{gathers}
IntentReport | IntentReport/{reportNumber} | icm:IntentReport | icm:reportNumber | reference | reportNumber
IntentReport | IntentReport/{reportNumber} | icm:IntentReport | icm:reportGenerated | reference | reportGenerated
IntentReport | IntentReport/{reportNumber} | icm:IntentReport | kg:informs | template | LevelOfTrust/{informs}
Intent | Intent/{identifier} | icm:Intent | dct:identifier | reference | identifier
Intent | Intent/{identifier} | icm:Intent | kg:scope | reference | scope
Intent | Intent/{identifier} | icm:Intent | kg:contains | template | IntentReport/{contains}
Intent | Intent/{identifier} | icm:Intent | kg:guaranteedBy | template | TrustLevelAgreement/{guaranteedBy}
Intent | Intent/{identifier} | icm:Intent | kg:deploys | template | NetworkService/{deploys}
TrustLevelAgreement | TrustLevelAgreement/{identifier} | kg:TrustLevelAgreement | dct:identifier | reference | identifier
TrustLevelAgreement | TrustLevelAgreement/{identifier} | kg:TrustLevelAgreement | kg:customerID | reference | customerID
TrustLevelAgreement | TrustLevelAgreement/{identifier} | kg:TrustLevelAgreement | kg:providerID | reference | providerID
TrustLevelAgreement | TrustLevelAgreement/{identifier} | kg:TrustLevelAgreement | kg:requirement | reference | requirement
TrustLevelAgreement | TrustLevelAgreement/{identifier} | kg:TrustLevelAgreement | kg:violationDescription | reference | violationDescription
TrustLevelAgreement | TrustLevelAgreement/{identifier} | kg:TrustLevelAgreement | kg:includes | template | LevelOfTrust/{includes}
AdministrativeDomain | AdministrativeDomain/{identifier} | kg:AdministrativeDomain | dct:identifier | reference | identifier
AdministrativeDomain | AdministrativeDomain/{identifier} | kg:AdministrativeDomain | dct:description | reference | description
AdministrativeDomain | AdministrativeDomain/{identifier} | kg:AdministrativeDomain | kg:owner | template | Organization/{owner}
AdministrativeDomain | AdministrativeDomain/{identifier} | kg:AdministrativeDomain | kg:monitors | template | NetworkService/{monitors}
NetworkService | NetworkService/{identifier} | kg:NetworkService | kg:networkServiceType | template | NetworkServiceType/{networkServiceType}
NetworkService | NetworkService/{identifier} | kg:NetworkService | kg:networkStatus | template | NetworkServiceStatus/{networkStatus}
NetworkService | NetworkService/{identifier} | kg:NetworkService | dct:identifier | reference | identifier
NetworkService | NetworkService/{identifier} | kg:NetworkService | dct:description | reference | description
NetworkService | NetworkService/{identifier} | kg:NetworkService | kg:characteristics | reference | characteristics
NetworkService | NetworkService/{identifier} | kg:NetworkService | kg:delivers | template | LevelOfTrust/{delivers}
NetworkService | NetworkService/{identifier} | kg:NetworkService | kg:composedBy | template | Asset/{composedBy}
Policy | Policy/{request} | kg:Policy | ordl:duty | template | Rule/{duty}
Policy | Policy/{request} | kg:Policy | dct:request | reference | request
Rule | Rule/{constraint} | kg:Rule | ordl:target | template | Asset/{target}
Rule | Rule/{constraint} | kg:Rule | dct:constraint | reference | constraint
Asset | Asset/{identifier} | kg:Asset | kg:assetType | template | AssetType/{assetType}
Asset | Asset/{identifier} | kg:Asset | dct:identifier | reference | identifier
Asset | Asset/{identifier} | kg:Asset | kg:endpoint | reference | endpoint
Asset | Asset/{identifier} | kg:Asset | kg:capacity | reference | capacity
Asset | Asset/{identifier} | kg:Asset | kg:fulfills | reference | fulfills
Asset | Asset/{identifier} | kg:Asset | kg:exposes | reference | exposes
Symptom | Symptom/{description} | kg:Symptom | kg:symptomType | template | SymptomType/{symptomType}
Symptom | Symptom/{description} | kg:Symptom | dct:description | reference | description
Symptom | Symptom/{description} | kg:Symptom | kg:pertains | reference | pertains
SubjectiveIndicator | SubjectiveIndicator/{weightingFactor} | kg:SubjectiveIndicator | kg:weightingFactor | reference | weightingFactor
SubjectiveIndicator | SubjectiveIndicator/{weightingFactor} | kg:SubjectiveIndicator | kg:value | reference | value
SubjectiveIndicator | SubjectiveIndicator/{weightingFactor} | kg:SubjectiveIndicator | rdfs:subClassOf | constant | kg:Indicator
ObjectiveIndicator | ObjectiveIndicator/{weightingFactor} | kg:ObjectiveIndicator | kg:weightingFactor | reference | weightingFactor
ObjectiveIndicator | ObjectiveIndicator/{weightingFactor} | kg:ObjectiveIndicator | kg:value | reference | value
ObjectiveIndicator | ObjectiveIndicator/{weightingFactor} | kg:ObjectiveIndicator | rdfs:subClassOf | constant | kg:Indicator
Health | Health/{healthScore} | kg:Health | kg:healthScore | reference | healthScore
Health | Health/{healthScore} | kg:Health | kg:connectionStatus | reference | connectionStatus
Health | Health/{healthScore} | kg:Health | kg:evaluates | reference | evaluates
"""

# Class -> its named instances.
FIXED_INSTANCES = {
    "DigitalServiceEntity": ("DigitalServiceProvider", "DigitalServiceCustomer"),
    "PunishmentAction": ("CustomerNotificationAction", "ProviderNotificationAction",
                         "EvaluatingOtherAssesstsAction", "EndingTrustAgreementAction"),
    "NetworkServiceStatus": (
        "InitializingNetworkService", "AllocatingNetworkService", "DeployingNetworkService",
        "RunningNetworkService", "InactiveNetworkService", "PausedNetworkService",
        "FinishedNetworkService", "MaintainingNetworkService", "ScalingNetworkService",
        "MigratingNetworkService", "OverloadNetworkService", "HealthyNetworkStatus"),
    "NetworkServiceType": ("Cloud", "Edge", "FarEdge", "CloudContinuum", "CloudEdgeContinuum"),
    "AssetType": ("Infrastructure", "Resource", "Subservice", "Service"),
    "SymptomType": ("CPU", "Memory", "Processes", "Networking", "VirtualMachines"),
    "SubjectiveIndicator": ("Credibility", "Feedback"),
    "ObjectiveIndicator": ("Availability", "Stability", "Reliability", "Scalability"),
}

MAPPING_COLUMNS = ("concept STRING, subject_template STRING, class STRING, predicate STRING, "
                   "object_kind STRING, object STRING")
TRIPLE = ("s", "p", "o", "o_is_iri")


def mapping_table(spark: SparkSession, text: str = CONCEPT_MAPPING) -> DataFrame:
    """Mapping rows from lines of six fields."""
    rows = [tuple(part.strip() for part in line.split("|")) for line in text.strip().splitlines()]
    return local_table(spark, rows, MAPPING_COLUMNS)


def iri_safe(value: Column) -> Column:
    """Percent-encode text for use inside an IRI."""
    return F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))


def template_parts(template: Column) -> Column:
    """Fixed texts and field names of a template, for :func:`fill_parts`."""
    return F.struct(F.split(template, r"\{[^}]*\}", -1).alias("texts"),
                    F.regexp_extract_all(template, F.lit(r"\{([^}]*)\}"), F.lit(1)).alias("fields"))


def fill_parts(parts: Column, record: Column, base: str) -> Column:
    """Base plus template with every field replaced; NULL when a field is missing."""
    values = F.transform(parts["fields"], lambda f: iri_safe(F.try_element_at(record, f)))
    return let(values, lambda vs: F.when(
        F.forall(vs, lambda v: v.isNotNull()),
        F.concat(F.lit(base), F.array_join(F.zip_with(parts["texts"], vs, lambda t, v: F.concat(
            t, F.coalesce(v, F.lit("")))), ""))))


def records_from_json(documents: DataFrame, concepts: Sequence[str], *keep: str) -> DataFrame:
    """``concept, record`` of single-key objects read as one nullable struct per concept."""
    entries = F.filter(F.array(*[
        F.struct(F.lit(c).alias("concept"), F.from_json(
            F.to_json(F.col(c)), "map<string,string>").alias("record")) for c in concepts]),
        lambda e: e["record"].isNotNull())
    return documents.select(*keep, F.explode(entries).alias("e")).select(
        *keep, "e.concept", "e.record")


def triples(records: DataFrame, mapping: DataFrame, base: str) -> DataFrame:
    """Distinct triples of concept records (``concept, record MAP``).

    The mapping is joined on the concept; a missing field gives no triple.
    """
    # One row per concept and subject, templates already taken apart: a record meets its
    # mapping once and computes its subject once.
    none = F.lit(None)
    concepts = mapping.select(
        "concept", "subject_template", "class", F.struct(
            F.col("predicate").alias("p"), F.col("object_kind").alias("kind"), F.col("object").alias("o"),
            F.when(F.col("object_kind") == "template", template_parts(F.col("object"))).otherwise(none)
            .alias("parts")).alias("pair")).groupBy("concept", "subject_template", "class").agg(
        F.collect_list("pair").alias("pairs")).withColumn(
        "subject", template_parts(F.col("subject_template"))).drop("subject_template")
    joined = records.join(concepts, "concept").select(
        "class", "pairs", "record", fill_parts(F.col("subject"), F.col("record"), base).alias("s"))
    record = F.col("record")

    def value(pair: Column) -> Column:
        return (F.when(pair["kind"] == "reference", F.try_element_at(record, pair["o"]))
                .when(pair["kind"] == "template", fill_parts(pair["parts"], record, base))
                .otherwise(pair["o"]))
    pairs = F.concat(
        F.array(F.struct(F.lit(RDF_TYPE).alias("p"), F.col("class").alias("o"), F.lit(True).alias("o_is_iri"))),
        F.transform("pairs", lambda pair: F.struct(
            pair["p"].alias("p"), value(pair).alias("o"),
            (pair["kind"] != "reference").alias("o_is_iri"))))
    return (joined.filter("s IS NOT NULL").select("s", F.explode(pairs).alias("t"))
            .filter("t.o IS NOT NULL").select("s", "t.p", "t.o", "t.o_is_iri").distinct())


def fixed_instances(spark: SparkSession, base: str, vocabulary: str = "kg:",
                    instances: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Type and label triples of the enumerations."""
    rows = [(f"{base}{cls}/{name}", p, o, iri)
            for cls, names in (instances or FIXED_INSTANCES).items() for name in names
            for p, o, iri in ((RDF_TYPE, vocabulary + cls, True), (LABEL, name, False))]
    return local_table(spark, rows, "s STRING, p STRING, o STRING, o_is_iri BOOLEAN")


def ntriples(rows: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """Triples as N-Triples lines, prefixed names expanded."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])

    def iri(c: Column) -> Column:
        space = F.try_element_at(table, F.substring_index(c, ":", 1))
        return F.concat(F.lit("<"), F.when(space.isNotNull(), F.concat(
            space, F.regexp_replace(c, r"^[^:]*:", ""))).otherwise(c), F.lit(">"))
    text = F.col("o")
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    obj = F.when(F.col("o_is_iri"), iri(F.col("o"))).otherwise(
        F.concat(F.lit('"'), text, F.lit('"')))
    return rows.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), obj, F.lit(".")).alias("value"))


def short_name(term: Column) -> Column:
    """Local part of a prefixed name or IRI."""
    return F.regexp_extract(term, r"([^:/#]*)$", 1)


def kg_nodes(rows: DataFrame) -> DataFrame:
    """``uri, labels, props`` per subject, object and class; of several literals the greatest is kept.

    Classes are labels of their members and nodes too. One pass over the triples: values are reduced per (node,
    predicate) before the shuffle, so a node named by very many triples arrives as one row per task, and its lists hold
    one entry per predicate and class at most.
    """
    literal = F.when(~F.col("o_is_iri"), F.col("o"))
    label = F.when(F.col("p") == RDF_TYPE, short_name(F.col("o")))
    ends = F.filter(F.array(
        F.struct(F.col("s").alias("uri"), F.col("p").alias("p"), literal.alias("value"), label.alias("label")),
        F.struct(F.when(F.col("o_is_iri"), F.col("o")).alias("uri"), F.lit("").alias("p"), F.lit(None).cast("string").alias("value"),
                 F.lit(None).cast("string").alias("label"))), lambda e: e["uri"].isNotNull())
    facts = (rows.select(F.explode(ends).alias("e")).select("e.*").groupBy("uri", "p").agg(
        F.max("value").alias("value"), F.collect_set("label").alias("labels")))
    pair = F.when(F.col("value").isNotNull(), F.struct(short_name(F.col("p")).alias("key"), "value"))
    return facts.groupBy("uri").agg(
        F.array_sort(F.flatten(F.collect_list("labels"))).alias("labels"),
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("props"))


def kg_edges(rows: DataFrame) -> DataFrame:
    """``src, rel, dst`` of all triples between nodes, those to the classes included."""
    return (rows.filter("o_is_iri").select(F.col("s").alias("src"), short_name(F.col("p")).alias("rel"), F.col("o").alias("dst")).distinct())


def duplicate_uris(nodes: DataFrame) -> DataFrame:
    """URIs that more than one node row has."""
    return nodes.groupBy("uri").count().filter("count > 1")


def cardinality_violations(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Subjects with more values of a predicate than ``concept, relation, max_cardinality`` allows.

    ``*`` is unbounded. Counts are combined before the shuffle.
    """
    limits = spec.filter("max_cardinality <> '*'").select(
        F.trim("concept").alias("label"), F.trim("relation").alias("rel"),
        F.trim("max_cardinality").try_cast("int").alias("most")).filter("most IS NOT NULL")
    label = F.when(F.col("p") == RDF_TYPE, short_name(F.col("o")))
    counts = rows.groupBy("s", short_name(F.col("p")).alias("rel")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(label).alias("labels"))
    # One entry per predicate and class of a subject.
    subjects = counts.groupBy("s").agg(F.collect_list(F.struct("rel", "n")).alias("rels"),
                                       F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"))
    pairs = subjects.select("s", F.explode("labels").alias("label"), "rels").select("s", "label", F.explode("rels").alias("r"))
    return (pairs.select("s", "label", "r.rel", "r.n").join(limits, ["label", "rel"])
            .filter("n > most").select("s", "label", "rel", "n", "most"))


def missing_relation(rows: DataFrame, label: str, relation: str, incoming: bool = False) -> DataFrame:
    """Subjects of a class without any value (or referrer) of a relation: a minimum-1 question."""
    members = rows.filter((F.col("p") == RDF_TYPE) & (short_name(F.col("o")) == label)).select("s").distinct()
    side = F.col("o") if incoming else F.col("s")
    having = rows.filter(short_name(F.col("p")) == relation).select(side.alias("s")).distinct()
    return members.join(having, "s", "left_anti")


def multiple_relation(rows: DataFrame, label: str, relation: str) -> DataFrame:
    """Subjects of a class with more than one value of a relation: an at-most-1 question."""
    members = rows.filter((F.col("p") == RDF_TYPE) & (short_name(F.col("o")) == label)).select("s").distinct()
    counts = rows.filter(short_name(F.col("p")) == relation).groupBy("s").agg(
        F.count_distinct("o").alias("n")).filter("n > 1")
    return counts.join(members, "s", "left_semi")


def related(rows: DataFrame, path: Sequence[str]) -> DataFrame:
    """``start, end`` of every chain of relations, one equi-join per step."""
    out = None
    for relation in path:
        step = rows.filter(short_name(F.col("p")) == relation)
        if out is None:
            out = step.select(F.col("s").alias("start"), F.col("o").alias("end"))
        else:
            hop = step.select(F.col("s").alias("end"), F.col("o").alias("_next"))
            out = out.join(hop, "end").select("start", F.col("_next").alias("end"))
    return out.distinct()


# Predicate -> lowest, highest, special value.
VALUE_RANGES = {"lot": (0.0, 1.0, None), "healthScore": (0.0, 100.0, -1.0),
                "health-score": (0.0, 100.0, None), "health-score-weight": (0.0, 100.0, None)}


def range_violations(rows: DataFrame,
                     ranges: Mapping[str, tuple[float, float, float | None]] | None = None) -> DataFrame:
    """Literals outside the range of their predicate, or no number at all."""
    out = F.lit(False)
    rel, value = short_name(F.col("p")), F.col("o").try_cast("double")
    for name, (low, high, special) in (ranges or VALUE_RANGES).items():
        good = value.between(low, high)
        if special is not None:
            good = good | (value == special)
        out = out | ((rel == name) & ~F.coalesce(good, F.lit(False)))
    return rows.filter(~F.col("o_is_iri") & out)

"""Standard synonyms of relations and entity types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Raw relation and canonical relation.
RELATION_SYNONYMS = """
utilizes uses
employs uses
leverages uses
makes_use_of uses
applies uses
utilized_by used_by
employed_by used_by
leveraged_by used_by
utilized_for used_for
employed_for used_for
applied_to used_for
implemented_by implements
realizes implements
instantiates implements
contains has_part
includes has_part
comprises has_part
is_part_of part_of
belongs_to part_of
contained_in part_of
included_in part_of
member_of part_of
depends_on requires
needs requires
is_required_by required_by
needed_by required_by
cites references
mentions references
refers_to references
cited_by referenced_by
mentioned_in referenced_by
referred_to_by referenced_by
wrote author_of
created author_of
authored author_of
written_by authored_by
created_by authored_by
explains describes
documents describes
explained_by described_by
documented_by described_by
described_in described_by
based_in located_in
situated_in located_in
found_in located_in
is_version_of version_of
variant_of version_of
edition_of version_of
supersedes replaces
obsoletes replaces
is_replaced_by replaced_by
superseded_by replaced_by
obsoleted_by replaced_by
works_for works_at
employed_at works_at
hires employs
related_to associated_with
connected_to associated_with
linked_to associated_with
is_a type_of
instance_of type_of
kind_of type_of
results_in produces
yields produces
generates produces
result_of produced_by
caused_by produced_by
generated_by produced_by
"""

#: Raw entity type and canonical type; the last row of a raw type holds.
TYPE_SYNONYMS = """
human person
individual person
author person
researcher person
developer person
user person
contributor person
maintainer person
company organization
corporation organization
institution organization
university organization
team organization
group organization
consortium organization
location place
city place
country place
region place
address place
venue place
conference event
meeting event
workshop event
release event
publication event
article document
paper document
report document
publication document
book document
chapter document
specification document
program software
application software
tool software
library software
framework software
package software
module software
plugin software
crate software
data dataset
corpus dataset
benchmark dataset
collection dataset
class code_entity
function code_entity
method code_entity
struct code_entity
enum code_entity
interface code_entity
trait code_entity
type code_entity
variable code_entity
constant code_entity
topic concept
idea concept
theme concept
subject concept
category concept
algorithm method
technique method
approach method
process method
procedure method
protocol method
pattern method
technology technology
language technology
platform technology
runtime technology
database technology
api technology
service technology
repository project
repo project
codebase project
version version
release version
edition version
revision version
file resource
image resource
video resource
audio resource
url resource
link resource
"""


def pairs(text: str) -> list[tuple[str, str]]:
    """Rows of a synonym text, the last of each raw value."""
    return list({raw: (raw, canonical) for raw, canonical in (line.split() for line in text.strip().splitlines())}.values())


def standard_synonyms(spark: SparkSession) -> DataFrame:
    """(raw, canonical) of the standard relations."""
    return spark.createDataFrame(pairs(RELATION_SYNONYMS), "raw string, canonical string")


def standard_types(spark: SparkSession) -> DataFrame:
    """(raw, canonical) of the standard entity types."""
    return spark.createDataFrame(pairs(TYPE_SYNONYMS), "raw string, canonical string")


def canonical_relations() -> list[str]:
    return sorted({c for _, c in pairs(RELATION_SYNONYMS)})


def canonical_entity_types() -> list[str]:
    """The canonical types in the order in which they first appear."""
    return list(dict.fromkeys(line.split()[1] for line in TYPE_SYNONYMS.strip().splitlines()))

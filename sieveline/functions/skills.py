"""Skill and domain evidence as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.binding import apply_sql, let_sql
from sieveline.functions.literals import quoted, strings
from sieveline.functions.text import strip
from sieveline.ontology import Ontology


def _array_of(rows: list[str], ddl: str) -> str:
    return f"cast(array({', '.join(rows)}) as array<struct<{ddl}>>)"


def _terms(pairs) -> str:
    rows = [f"struct({quoted(n)}, {quoted(s)})" for n, s in pairs]
    return _array_of(rows, "needle:string,skill:string")


def normalize_skill(skill: Column, ontology: Ontology) -> Column:
    """Trim, lower-case and follow one alias."""
    table = f"map_from_entries({_terms(ontology.aliases.items())})"
    return apply_sql(
        F.lower(strip(F.coalesce(skill, F.lit("")))), "k", f"coalesce(try_element_at({table}, k), k)"
    )


def skills_in(text: Column, ontology: Ontology) -> Column:
    """Distinct canonical skills whose name or alias occurs anywhere in the text, sorted."""
    hits = f"filter({_terms(ontology.terms())}, x -> contains(t, x.needle))"
    return apply_sql(
        F.lower(F.coalesce(text, F.lit(""))), "t", f"sort_array(array_distinct(transform({hits}, x -> x.skill)))"
    )


def domain_evidence(skills: Column, ontology: Ontology) -> Column:
    """One entry per domain in ontology order: matched skills, their number, and that number
    relative to the best domain of the row."""
    domains = _array_of(
        [
            f"struct({pos}, {quoted(name)}, {strings(sorted({s.lower() for s in members}))})"
            for pos, (name, members) in enumerate(ontology.domains.items())
        ],
        "domain_pos:int,domain:string,skills:array<string>",
    )
    overlap = f"""transform({domains}, d -> named_struct('domain_pos', d.domain_pos, 'domain', d.domain,
        'matched', sort_array(array_intersect(d.skills, mine))))"""
    scaled = """transform(rows, r -> named_struct('domain_pos', r.domain_pos, 'domain', r.domain,
        'matched', r.matched, 'n_overlap', size(r.matched),
        'score', if(top > 0, size(r.matched) / top, cast(0 as double))))"""
    best = "array_max(transform(rows, r -> size(r.matched)))"
    body = let_sql(overlap, "rows", let_sql(best, "top", scaled))
    lowered = "transform(coalesce(s, cast(array() as array<string>)), x -> lower(x))"
    return apply_sql(skills, "s", let_sql(lowered, "mine", body))


def top_domains(evidence: Column, k: int = 3) -> Column:
    """The k best domains, ties in ontology order."""
    keyed = """transform(e, x -> named_struct('key', -x.score, 'domain_pos', x.domain_pos,
        'domain', x.domain, 'score', x.score))"""
    return apply_sql(evidence, "e", f"slice(sort_array({keyed}), 1, {k})")

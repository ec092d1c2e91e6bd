"""The same results in plain SQL for DuckDB, written independently of the Spark side.

Each statement is put together from named common table expressions. Regular expressions here
use the ASCII classes of RE2; the Unicode rules are covered by the unit tests.
"""

from checks.fixtures import (
    CHUNK_DOC,
    CHUNK_NAME,
    CLASS_NAMES,
    DOC_TEXT,
    DOC_VECTOR,
    FIRST_JOB,
    JOB_TEXT,
    JOB_VECTOR,
    SECOND_JOB,
)

# Fixed values, written out here a second time so that the SQL does not lean on the code it checks.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SECTION_HEADERS = {
    "summary": ["summary", "professional summary", "profile", "objective"],
    "skills": ["skills", "technical skills", "core skills", "key skills"],
    "experience": ["experience", "work experience", "professional experience", "employment", "employment history"],
}
DOMAINS = {
    "Data Science": "python|pandas|numpy|scikit-learn|machine learning|statistics|data analysis|tensorflow|pytorch",
    "Web Development": "javascript|html|css|react|node|flask|django|rest api|sql",
    "DevOps": "docker|kubernetes|ci/cd|jenkins|aws|linux|terraform",
    "Mobile Development": "android|kotlin|swift|react native|flutter",
    "Cybersecurity": "network security|penetration testing|siem|incident response|cryptography",
}
ALIASES = {"ml": "machine learning", "scikit learn": "scikit-learn", "rest": "rest api"}

N_JOBS = "(select count(*) from benchmark)"
DOC_VEC = DOC_VECTOR.format(n_vecs="(select count(*) from embeddings)")
ORACLE: dict[str, str] = {}
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000"


def f3(x: str) -> str:
    return f"printf('%.3f', floor(({x}) * 1000 + 0.5) / 1000)"


def strip(x: str) -> str:
    return f"trim({x}, {q(SPACE_CHARS)})"


def values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(r) + ")" for r in rows) + ")"


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body.replace("{DOC_VEC}", DOC_VEC), needs)


def ask(key: str, body: str, *needs: str) -> None:
    seen: list[str] = []

    def visit(name):
        if name in seen:
            return
        for n in CTES[name][1]:
            visit(n)
        seen.append(name)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} as ({CTES[n][0]})" for n in seen)
    ORACLE[key] = (f"with recursive {head}\n" if seen else "") + body.replace("{DOC_VEC}", DOC_VEC)


# ---- text ------------------------------------------------------------------------------------


def html(x):
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def email(x):
    return rf"regexp_replace({x}, '\b[\p{{L}}\p{{N}}_.%-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}\b', ' ', 'g')"


def url(x):
    return rf"regexp_replace({x}, '\b(?:https?://|www\.)\S+\b', ' ', 'g')"


PHONE = r"(?:\+?\d{1,3}[\s-]?)?(?:\(\d{2,4}\)[\s-]?)?\d{3,4}[\s-]?\d{3,4}"


def phone(x):
    return f"regexp_replace({x}, '{PHONE}', ' ', 'g')"


def collapse(x):
    x = f"replace({x}, chr(160), ' ')"
    x = rf"regexp_replace({x}, '[\t\r\f\x0b]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    x = f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"
    return strip(x)


def dedup_ctes(name: str, source: str, *needs: str) -> None:
    """name(k, out) from source(k, raw): lines trimmed, boilerplate and repeated short lines gone."""
    cte(
        f"{name}_l",
        rf"""select k, string_split_regex(raw, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') as l from {source}""",
        source,
        *needs,
    )
    cte(
        f"{name}_t",
        f"""select k, list_transform(case when l[len(l)] = '' then l[1:len(l) - 1] else l end, lambda s: {strip("s")}) as l
        from {name}_l""",
        f"{name}_l",
    )
    cte(f"{name}_k", f"select k, l, list_transform(l, lambda s: lower(s)) as low from {name}_t", f"{name}_t")
    cte(
        name,
        f"""select k, coalesce(array_to_string(list_filter(l, lambda s, i: low[i] not in ('resume', 'curriculum vitae', 'cv', 'page')
          and not (length(low[i]) between 1 and 40 and list_contains(low[1:i - 1], low[i]))), chr(10)), '') as out
        from {name}_k""",
        f"{name}_k",
    )


def clean_ctes(name: str, source: str, *needs: str) -> None:
    """name(k, out) from source(k, raw): the full cleaning chain."""
    cte(f"{name}_e", f"select k, {phone(url(email(html("coalesce(raw, '')"))))} as raw from {source}", source, *needs)
    dedup_ctes(f"{name}_d", f"{name}_e")
    cte(name, f"select k, lower({collapse('out')}) as out from {name}_d", f"{name}_d")


cte("screening", f"select doc_id, {DOC_TEXT} as doc_text from documents")
cte("jobs", f"select item_id as job_id, {JOB_TEXT} as jd_text, {JOB_VECTOR} as vec_id from benchmark")
cte("doc_raw", "select doc_id as k, doc_text as raw from screening", "screening")
cte("job_raw", "select job_id as k, jd_text as raw from jobs", "jobs")
cte("plain_raw", "select doc_id as k, text as raw from documents")
clean_ctes("doc_clean", "doc_raw")
clean_ctes("job_clean", "job_raw")
clean_ctes("plain_clean", "plain_raw")

ask("strip_html", f"select page_id, {html('html')} as out from pages")
ask("strip_email", f"select doc_id, {email('text')} as out from documents")
ask("strip_url", f"select doc_id, {url('doc_text')} as out from screening", "screening")
ask("strip_phone", f"select doc_id, {phone('text')} as out from documents")
dedup_ctes("plain_dedup", "plain_raw")
ask("drop_repeated_lines", "select k as doc_id, out from plain_dedup", "plain_dedup")
ask("collapse_whitespace", f"select page_id, {collapse('html')} as out from pages")
ask("clean_text", "select k as doc_id, out from plain_clean", "plain_clean")
ask(
    "noise_counts",
    rf"""select doc_id, len(regexp_extract_all(doc_text, '<[^>]+>')) as n_html,
      len(regexp_extract_all(doc_text, '\b[\p{{L}}\p{{N}}_.%-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}\b')) as n_email,
      len(regexp_extract_all(doc_text, '\b(?:https?://|www\.)\S+\b')) as n_url,
      len(regexp_extract_all(doc_text, '{PHONE}')) as n_phone from screening""",
    "screening",
)
ask(
    "years_experience",
    r"""select doc_id, coalesce(list_max(list_transform(
      regexp_extract_all(lower(doc_text), '\b(\d{1,2})\s*\+?\s*years\b', 1), lambda d: cast(d as bigint))), 0) as years
    from screening""",
    "screening",
)
ask(
    "reject_blank",
    f"""select id, body, case when {strip('body')} = '' then 'Resume text is required' else '' end as reason
    from (select job_id as id, jd_text as body from jobs union all select doc_id, text from documents)""",
    "jobs",
)

# ---- sections --------------------------------------------------------------------------------


def section_ctes(prefix: str, cleaned: str) -> None:
    """prefix_headers(k, place, pos, section) and prefix_sections(k, summary, skills, experience, full_text)."""
    branches, rank = [], 0
    for section, variants in SECTION_HEADERS.items():
        for v in variants:
            pattern = rf"(^|\n)\s*{v}\s*[:\-]?\s*(\n|$)"
            branches.append(
                f"""select k, {rank} as rank, {q(section)} as section,
                list_transform(regexp_extract_all(out, '{pattern}'), lambda s: length(s)) as hits,
                list_transform(string_split_regex(out, '{pattern}'), lambda s: length(s)) as gaps
                from {cleaned}"""
            )
            rank += 1
    cte(f"{prefix}_m", " union all ".join(branches), cleaned)
    cte(
        f"{prefix}_p",
        f"""select k, rank, section, cast(list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i - 1]), 0) as bigint) as pos
        from (select *, unnest(range(1, len(hits) + 1)) as i from {prefix}_m where len(hits) > 0)""",
        f"{prefix}_m",
    )
    cte(
        f"{prefix}_o",
        f"select k, section, pos, row_number() over (partition by k order by pos, rank) as rn from {prefix}_p",
        f"{prefix}_p",
    )
    cte(
        f"{prefix}_w",
        f"""select k, rn, pos, section, pos as last_pos, section as last_section, true as kept
          from {prefix}_o where rn = 1
        union all
        select o.k, o.rn, o.pos, o.section,
          case when o.section = w.last_section and o.pos - w.last_pos < 50 then w.last_pos else o.pos end,
          case when o.section = w.last_section and o.pos - w.last_pos < 50 then w.last_section else o.section end,
          not (o.section = w.last_section and o.pos - w.last_pos < 50)
        from {prefix}_w w join {prefix}_o o on o.k = w.k and o.rn = w.rn + 1""",
        f"{prefix}_o",
    )
    cte(
        f"{prefix}_headers",
        f"""select k, row_number() over (partition by k order by pos, rn) - 1 as place, pos, section
        from {prefix}_w where kept""",
        f"{prefix}_w",
    )
    cte(
        f"{prefix}_b",
        rf"""select k, place, section, {strip(
            "regexp_replace("
            + strip("substr(out, pos + 1, coalesce(next_pos, length(out)) - pos)")
            + r", '^\s*([a-z ]{3,40})\s*[:\-]?\s*\n', '')"
        )} as body
        from (select h.*, c.out, lead(pos) over (partition by h.k order by place) as next_pos
              from {prefix}_headers h join {cleaned} c on c.k = h.k)""",
        f"{prefix}_headers",
    )
    cte(
        f"{prefix}_best",
        f"""select k, section, body from (select *, row_number() over (partition by k, section
        order by length(body) desc, place) as rn from {prefix}_b) where rn = 1""",
        f"{prefix}_b",
    )
    cte(
        f"{prefix}_sections",
        f"""select c.k, {", ".join(
            f"coalesce(max(case when section = '{s}' then body end), '') as {s}" for s in SECTION_HEADERS
        )}, any_value(c.out) as full_text
        from {cleaned} c left join {prefix}_best b on b.k = c.k group by c.k""",
        f"{prefix}_best",
    )


def chunk_ctes(prefix: str) -> None:
    cte(
        f"{prefix}_parts",
        " union all ".join(
            f"select (k || '/{p}') as k, {p} as raw from {prefix}_sections"
            for p in ("summary", "skills", "experience", "full_text")
        ),
        f"{prefix}_sections",
    )
    clean_ctes(f"{prefix}_again", f"{prefix}_parts")

    def cap(x, n):
        return strip(f"substr({strip(x)}, 1, {n})")

    cte(
        f"{prefix}_chunks",
        f"""select k, summary,
          case when summary = '' and skills = '' and experience = '' then {cap('full_text', 1200)}
            else {cap('experience', 1200)} end as experience,
          {cap('skills', 400)} as skills
        from (select s.k, {", ".join(
            f"max(case when a.k = s.k || '/{p}' then {strip('a.out')} end) as {p}"
            for p in ("summary", "skills", "experience", "full_text")
        )}
          from (select unnest([k || '/summary', k || '/skills', k || '/experience', k || '/full_text']) as part, k
                from {prefix}_sections) s
          join {prefix}_again a on a.k = s.part group by s.k)""",
        f"{prefix}_again",
    )


section_ctes("doc", "doc_clean")
chunk_ctes("doc")
section_ctes("plain", "plain_clean")
chunk_ctes("plain")

ask("section_headers", "select k as doc_id, place, pos, section from doc_headers", "doc_headers")
ask("extract_sections", "select k as doc_id, summary, skills, experience, full_text from doc_sections", "doc_sections")
ask(
    "embedding_text",
    f"""select k as doc_id, case when summary = '' and skills = '' and experience = '' then {strip('full_text')}
      else {strip("concat_ws(chr(10), case when summary <> '' then 'summary: ' || summary end, "
                  "case when skills <> '' then 'skills: ' || skills end, "
                  "case when experience <> '' then 'experience: ' || experience end)")} end as out
    from doc_sections""",
    "doc_sections",
)
ask("build_chunks", "select k as doc_id, summary, experience, skills from doc_chunks", "doc_chunks")
ask(
    "preprocess_corpus",
    "select cast(k as varchar) as id, summary, experience, skills from plain_chunks",
    "plain_chunks",
)
cte(
    "doc_lengths",
    "select k as doc_id, length(summary) as summary_len, length(experience) as experience_len, length(skills) as skills_len from doc_chunks",
    "doc_chunks",
)
ask("chunk_profile", "select * from doc_lengths", "doc_lengths")

# ---- sources and sinks -----------------------------------------------------------------------

ask(
    "corpus_normalize",
    """select cast(d.doc_id as varchar) as id, coalesce(d.text, '') as doc_text,
      coalesce('q' || cast(l.quality as varchar), 'Unknown') as label
    from documents d left join labels l on l.doc_id = d.doc_id""",
)
# A text table has marks for "missing", which a typed table has not.
ask(
    "corpus_from_csv",
    """select cast(d.doc_id as varchar) as id,
      case when d.text in ('NA', 'N/A', 'NULL', 'null', 'None', 'nan', 'NaN', 'n/a') then '' else coalesce(d.text, '') end as doc_text,
      coalesce('q' || cast(l.quality as varchar), 'Unknown') as label
    from documents d left join labels l on l.doc_id = d.doc_id""",
)
ask("assign_row_ids", "select doc_id, cast(row_number() over (order by doc_id) - 1 as varchar) as row_id from documents")
ask(
    "assemble_pages",
    f"""select conv_id, coalesce(string_agg(text, chr(10) order by turn, text) filter ({strip('text')} <> ''), '') as doc_text
    from conversations group by conv_id""",
)
ask("decode_text_files", "select doc_id, text as doc_text from documents")
ask(
    "ontology_tables",
    """select domain, row_number() over (partition by domain order by skill) - 1 as skill_pos, skill
    from (select distinct p_brand as domain, p_name as skill from part)""",
)
ask("all_skills", "select distinct lower(p_name) as skill from part")

# ---- skills and domains ----------------------------------------------------------------------

cte("terms", f"select * from {values([(q(s), q(s)) for d in DOMAINS.values() for s in d.split("|")] + [(q(a), q(s)) for a, s in ALIASES.items()])} t(needle, skill)")
cte(
    "domain_skill",
    f"""select * from {values([
        (str(i), q(d), q(s.lower())) for i, (d, skills) in enumerate(DOMAINS.items()) for s in skills.split("|")
    ])} t(domain_pos, domain, skill)""",
)
cte("doc_skill", "select distinct k as doc_id, skill from doc_clean join terms on contains(lower(out), needle)", "doc_clean", "terms")
cte("job_skill", "select distinct k as job_id, skill from job_clean join terms on contains(lower(out), needle)", "job_clean", "terms")


def text_list(column="skill", sep="|"):
    return f"coalesce(string_agg({column}, '{sep}' order by {column}), '')"


cte(
    "doc_skills",
    f"select d.doc_id, {text_list()} as skills from documents d left join doc_skill s on s.doc_id = d.doc_id group by d.doc_id",
    "doc_skill",
)
aliases = " ".join(f"when {q(a)} then {q(c)}" for a, c in ALIASES.items())
ask(
    "normalize_skills",
    f"""select doc_id, place, raw, case lower({strip('raw')}) {aliases} else lower({strip('raw')}) end as skill
    from (select doc_id, unnest(range(0, len(l))) as place, unnest(l) as raw
          from (select doc_id, string_split_regex(doc_text, '[,\\n]') as l from screening))""",
    "screening",
)
ask("extract_skills", "select doc_id, skills from doc_skills", "doc_skills")
ask(
    "extract_skills_joined",
    """select * from (with p as (select p_partkey % (select count(*) from part) as place, lower(p_name) as p_name from part),
    s as (select distinct lower(p_name) as needle, lower(p_name) as skill from part union select 'the', 'small ring'),
    d as (select c.k as doc_id, c.out || ' x' || coalesce(p.p_name, '') || 'y' as txt from doc_clean c
      left join p on p.place = c.k % (select count(*) from part)),
    m as (select distinct doc_id, skill from d join s on contains(lower(txt), needle))
    select d.doc_id, coalesce(string_agg(m.skill, '|' order by m.skill), '') as skills from d left join m on m.doc_id = d.doc_id group by d.doc_id)""",
    "doc_clean",
)
ask("skill_frequency", "select skill, count(*) as n from doc_skill group by skill", "doc_skill")


def evidence_ctes(prefix: str, keys: str, skill_table: str, *needs: str) -> None:
    cte(
        f"{prefix}_overlap",
        f"""select k.doc_id, d.domain_pos, d.domain, count(s.skill) as n_overlap,
          coalesce(string_agg(s.skill, '|' order by s.skill), '') as matched
        from {keys} k cross join domain_skill d left join {skill_table} s on s.doc_id = k.doc_id and s.skill = d.skill
        group by k.doc_id, d.domain_pos, d.domain""",
        "domain_skill",
        skill_table,
        *needs,
    )
    cte(
        f"{prefix}_scores",
        f"""select doc_id, domain_pos, domain, case when max(n_overlap) over (partition by doc_id) > 0
          then n_overlap / cast(max(n_overlap) over (partition by doc_id) as double) else cast(0 as double) end as score
        from {prefix}_overlap""",
        f"{prefix}_overlap",
    )
    cte(
        f"{prefix}_best_domain",
        f"""select doc_id, domain, score, row_number() over (partition by doc_id order by score desc, domain_pos) as rank
        from {prefix}_scores""",
        f"{prefix}_scores",
    )


evidence_ctes("doc", "documents", "doc_skill")
ask("domain_overlap", "select doc_id, domain, n_overlap, matched from doc_overlap", "doc_overlap")
ask("domain_scores", f"select doc_id, domain, {r6('score')} as score from doc_scores", "doc_scores")
ask("top_domains", f"select doc_id, rank, domain, {r6('score')} as score from doc_best_domain where rank <= 3", "doc_best_domain")

# ---- embedding jobs --------------------------------------------------------------------------

ask("content_fingerprint", "select doc_id, sha256(text || chr(0)) as fingerprint from documents")
cte(
    "token_counts",
    r"""select doc_id, ('0x' || substr(md5(t), 1, 8))::bigint % 64 as i, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as t from documents) group by all""",
)
cte(
    "hashed",
    """select d.doc_id, g.i, coalesce(c.n, 0) as n from documents d cross join (select unnest(range(0, 64)) as i) g
    left join token_counts c on c.doc_id = d.doc_id and c.i = g.i""",
    "token_counts",
)
cte(
    "hashed_unit",
    """select doc_id, i, n / case when sum(n * n) over (partition by doc_id) = 0 then 1.0::double
      else sqrt(cast(sum(n * n) over (partition by doc_id) as double)) end as v from hashed""",
    "hashed",
)
ask(
    "embed_incremental",
    f"""select h.doc_id, cast(d.text not in (select text from documents where lang = 'en') as bigint) as was_pending, i, {r6('v')} as v
    from hashed_unit h join documents d on d.doc_id = h.doc_id""",
    "hashed_unit",
)
ask("encode_text", f"select doc_id, i, {r6('v')} as v from hashed_unit", "hashed_unit")
ask("l2_normalize", f"select doc_id, i, {r6('v')} as v from hashed_unit", "hashed_unit")
cte(
    "chunk_dims",
    f"""select {CHUNK_DOC} as doc_id, case {CHUNK_NAME} when 'summary' then 0.4::double when 'experience' then 0.4::double
      when 'skills' then 0.2::double else 0::double end as w, unnest(range(0, len(embedding))) as i,
      cast(unnest(embedding) as double) as v from embeddings""",
)
cte("pooled", "select doc_id, i, sum(w * v) as s from chunk_dims group by doc_id, i", "chunk_dims")
ask(
    "pool_chunks",
    f"""select doc_id, i, {r6("s / case when norm = 0 then 1 else norm end")} as v
    from (select *, sqrt(sum(s * s) over (partition by doc_id)) as norm from pooled)""",
    "pooled",
)

cte(
    "plain_vectors",
    """select k as doc_id, i, sum(w * case i when 0 then length(t) when 1 then length(t) - length(replace(t, ' ', ''))
      else length(t) - length(replace(t, 'e', '')) end) as s
    from (select k, unnest([summary, experience, skills]) as t, unnest([0.4::double, 0.4::double, 0.2::double]) as w from doc_chunks)
    cross join (select unnest(range(0, 3)) as i) group by k, i""",
    "doc_chunks",
)
ask(
    "encode_plugin",
    f"""select doc_id, i, {r6("s / case when norm = 0 then 1 else norm end")} as v
    from (select *, sqrt(sum(s * s) over (partition by doc_id)) as norm from plain_vectors)""",
    "plain_vectors",
)

# ---- similarity and matching -----------------------------------------------------------------

cte("vecs", "select vec_id, label, cast(embedding as double[]) as v from embeddings")
cte("doc_vec", "select d.doc_id, e.v from documents d join vecs e on e.vec_id = d.{DOC_VEC}", "vecs")
cte("job_vec", "select j.job_id, e.v from jobs j left join vecs e on e.vec_id = j.vec_id", "jobs", "vecs")
cte(
    "requests",
    f"select distinct doc_id, job_id from (select doc_id, {FIRST_JOB.format(n_jobs=N_JOBS)} as job_id from documents union all select doc_id, {SECOND_JOB.format(n_jobs=N_JOBS)} from documents)",
)


def cosine(a, b):
    zero = f"list_dot_product({a}, {a}) = 0 or list_dot_product({b}, {b}) = 0"
    return f"case when {zero} then 0 else list_cosine_similarity({a}, {b}) end"


cte(
    "pair_sim",
    f"""select r.doc_id, r.job_id, {cosine('d.v', 'j.v')} as sim, d.v is not null and j.v is not null as ready
    from requests r join doc_vec d on d.doc_id = r.doc_id join job_vec j on j.job_id = r.job_id""",
    "requests",
    "doc_vec",
    "job_vec",
)
ask("pair_cosine", f"select doc_id, job_id, case when ready then {r6('sim')} end as similarity from pair_sim", "pair_sim")


def ranked(name, queries, qkey, qv, corpus, ckey, n=5):
    cte(
        name,
        f"""select {qkey}, {ckey}, round(sim, 9) as similarity, rank from (
          select *, row_number() over (partition by {qkey} order by round(sim, 9) desc, {ckey}) as rank
          from (select a.{qkey}, b.{ckey}, {cosine(f'a.{qv}', 'b.v')} as sim
                from {queries} a cross join {corpus} b where a.{qv} is not null)) where rank <= {n}""",
        queries,
        corpus,
    )


cte(
    "dims",
    """select vec_id, label, unnest(range(0, len(v))) as i, unnest(v) as x from vecs""",
    "vecs",
)
cte("centers", "select label as class, i, avg(x) as c from dims group by label, i", "dims")
cte("means", "select class as label, list(c order by i) as m from centers group by class", "centers")
ranked("top_means", "means", "label", "m", "vecs", "vec_id")
ranked("top_jobs", "job_vec", "job_id", "v", "doc_vec", "doc_id")
cte("vec_queries", "select vec_id as query_id, v as qv from vecs", "vecs")
ranked("top_vecs", "vec_queries", "query_id", "qv", "vecs", "vec_id")
ask("topn_similar", f"select label, rank, vec_id, {r6('similarity')} as similarity from top_means", "top_means")
ask("ranked_from_store", f"select job_id, rank, doc_id, {r6('similarity')} as similarity from top_jobs", "top_jobs")
ask("jd_ranked_docs", f"select job_id, rank, doc_id, {r6('similarity')} as similarity from top_jobs", "top_jobs")
ask("similar_docs", f"select query_id, rank, vec_id, {r6('similarity')} as similarity from top_vecs", "top_vecs")

cte(
    "pair_skill",
    f"""select r.doc_id, r.job_id,
      coalesce(string_agg(j.skill, '|' order by j.skill) filter (d.skill is not null), '') as matched,
      coalesce(string_agg(j.skill, '|' order by j.skill) filter (d.skill is null), '') as missing,
      count(j.skill) filter (d.skill is not null) as n_matched, count(j.skill) filter (d.skill is null) as n_missing
    from requests r left join job_skill j on j.job_id = r.job_id
    left join doc_skill d on d.doc_id = r.doc_id and d.skill = j.skill group by r.doc_id, r.job_id""",
    "requests",
    "job_skill",
    "doc_skill",
)
cte(
    "matches",
    f"""select p.doc_id, p.job_id, case when ready then sim else 0 end as similarity,
      case when ready then matched else '' end as matched, case when ready then missing else '' end as missing,
      case when ready then 'Cosine similarity in MPNet embedding space: ' || {f3('sim')} || '. Matched ' || n_matched ||
        ' skills; missing ' || n_missing || ' skills from the JD.'
      else 'Job matching unavailable due to missing embeddings.' end as explanation
    from pair_sim p join pair_skill s on s.doc_id = p.doc_id and s.job_id = p.job_id""",
    "pair_sim",
    "pair_skill",
)
ask("matched_skills", "select doc_id, job_id, matched from matches", "matches")
ask("missing_skills", "select doc_id, job_id, missing from matches", "matches")
ask("match_pairs", f"select doc_id, job_id, {r6('similarity')} as similarity, matched, missing, explanation from matches", "matches")

# ---- models ----------------------------------------------------------------------------------

ask("label_encode", "select doc_id, source as label, dense_rank() over (order by source) - 1 as label_id from documents")
cte("label_n", "select label, count(*) as n, sum(count(*)) over () as total from embeddings group by label")
cte(
    "shares",
    """select label, n, wanted, cast(floor(n * wanted / total) as bigint) as base, (n * wanted) % total as rest
    from (select *, ceil(0.2::double * total)::bigint as wanted, total::bigint as total_ from label_n)""",
    "label_n",
)
cte(
    "quotas",
    """select label, base + case when row_number() over (order by rest desc, label) <= wanted - sum(base) over () then 1 else 0 end as quota
    from shares""",
    "shares",
)
cte(
    "split",
    """select vec_id, e.label, case when row_number() over (partition by e.label order by md5('42|' || vec_id), vec_id) <= quota
      then 'test' else 'train' end as split from embeddings e join quotas q on q.label = e.label""",
    "quotas",
)
ask("stratified_split", "select vec_id, label, split from split", "split")
ask(
    "split_counts",
    """select count(*) filter (split = 'train') as n_train, count(*) filter (split = 'test') as n_test,
      array_to_string(list_sort(list(distinct cast(label as varchar))), ',') as classes from split""",
    "split",
)
ask(
    "class_weights",
    f"select label, n, {r6('total / cast((select count(*) from label_n) * n as double)')} as weight from label_n",
    "label_n",
)
ask("model_roundtrip", "select vec_id, cast(1 as bigint) as same_probabilities, cast(1 as bigint) as same_cluster from embeddings")

ask(
    "train_classifier",
    f"""select class, n, {r6('total / cast(count(*) over () * n as double)')} as weight, cast(1 as bigint) as is_optimal
    from (select cast(label as varchar) as class, count(*) as n, sum(count(*)) over () as total from split where split = 'train' group by label)""",
    "split",
)
ask(
    "class_probabilities",
    """select vec_id, split, (select string_agg(distinct cast(label as varchar), ',' order by cast(label as varchar)) from split
      where split = 'train') as classes, cast(1 as bigint) as descends, cast(1 as bigint) as adds_up, cast(1 as bigint) as is_share
    from split""",
    "split",
)
ask("train_kmeans", "select vec_id, cast(10 as bigint) as clusters, cast(1 as bigint) as is_nearest from embeddings")

cte(
    "dots",
    "select d.vec_id as doc_id, d.label as y_true, c.class, sum(d.x * c.c) as dot from dims d join centers c on c.i = d.i group by all",
    "dims",
    "centers",
)
cte("preds", "select doc_id, y_true, class, exp(10 * dot) / sum(exp(10 * dot)) over (partition by doc_id) as p from dots", "dots")
cte("pred_rank", "select *, row_number() over (partition by doc_id order by p desc, class) as rank from preds", "preds")
class_name = "case class " + " ".join(f"when {i} then {q(n)}" for i, n in enumerate(CLASS_NAMES)) + " end"
ask(
    "top3_classes",
    f"""select doc_id as vec_id, {r6('max(p) over (partition by doc_id)')} as max_p, rank, {class_name} as domain,
      {r6('p * 100.0')} as pct from pred_rank qualify rank <= 3""",
    "pred_rank",
)
cte(
    "assigned",
    """select vec_id, v, label as cluster_id from (select a.vec_id, a.v, m.label,
      row_number() over (partition by a.vec_id order by list_distance(a.v, m.m), m.label) as rn
      from vecs a cross join means m) where rn = 1""",
    "vecs",
    "means",
)
ask("assign_clusters", "select vec_id, cast(cluster_id as bigint) as cluster_id from assigned", "assigned")
ask(
    "cluster_profile",
    f"""select cast(cluster_id as bigint) as cluster_id, max(n) as n, i, {r6('avg(x)')} as v from (
      select cluster_id, count(*) over (partition by cluster_id) as n, unnest(range(0, len(v))) as i, unnest(v) as x from assigned)
    group by cluster_id, i""",
    "assigned",
)
ask(
    "corpus_index",
    f"""select doc_id, cluster_id, columns, i, {r6('v')} as v from (
      select d.doc_id, cast(a.cluster_id as bigint) as cluster_id, 'doc_id,embedding,cluster_id' as columns,
        unnest(range(0, len(a.v))) as i, unnest(a.v) as v from documents d join assigned a on a.vec_id = d.{DOC_VEC})""",
    "assigned",
)
cte(
    "cluster_dist",
    """select a.vec_id, a.label as own, b.label as other, sum(list_distance(a.v, b.v)) as total, count(*) as n
    from vecs a cross join vecs b where a.vec_id <> b.vec_id group by all""",
    "vecs",
)
cte(
    "widths",
    """select vec_id, max(case when own = other then total / n end) as a, min(case when own <> other then total / n end) as b
    from cluster_dist group by vec_id""",
    "cluster_dist",
)
cte(
    "silhouettes",
    "select avg(case when a is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end) as silhouette, count(*) as n from widths",
    "widths",
)
ask("silhouette", f"select {r6('silhouette')} as silhouette, n from silhouettes", "silhouettes")

# ---- metrics ---------------------------------------------------------------------------------

cte(
    "results",
    """select doc_id, y_true, max(case when rank = 1 then class end) as y_pred, max(case when class = y_true then rank end) as truth_rank
    from pred_rank group by doc_id, y_true""",
    "pred_rank",
)
cte(
    "by_class",
    """select class, (select count(*) from results where y_true = class and y_pred = class) as tp,
      (select count(*) from results where y_pred = class) as predicted,
      (select count(*) from results where y_true = class) as support
    from (select y_true as class from results union select y_pred from results)""",
    "results",
)
cte(
    "report",
    """select class, case when predicted = 0 then 0 else tp / cast(predicted as double) end as precision,
      case when support = 0 then 0 else tp / cast(support as double) end as recall,
      case when predicted + support = 0 then 0 else 2.0::double * tp / (predicted + support) end as f1, support from by_class""",
    "by_class",
)
cte(
    "averages",
    """select 'macro avg' as average, avg(precision) as precision, avg(recall) as recall, avg(f1) as f1, cast(sum(support) as bigint) as support from report
    union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
      sum(f1 * support) / sum(support), cast(sum(support) as bigint) from report""",
    "report",
)
cte(
    "summary",
    """select r.accuracy, m.precision as precision_macro, m.recall as recall_macro, m.f1 as f1_macro, r.top3 as top3_accuracy,
      r.top3 as precision_at_3, r.mrr
    from (select avg(cast(y_true = y_pred as int)) as accuracy, avg(cast(coalesce(truth_rank <= 3, false) as int)) as top3,
      avg(coalesce(1.0::double / truth_rank, 0)) as mrr from results) r, averages m where m.average = 'macro avg'""",
    "results",
    "averages",
)
ask("accuracy", f"select {r6('accuracy')} as accuracy from summary", "summary")
ask(
    "confusion_counts",
    "select cast(y_true as bigint) as y_true, cast(y_pred as bigint) as y_pred, count(*) as n from results group by all",
    "results",
)
ask(
    "macro_prf",
    "select " + ", ".join(f"{r6(c)} as {c}" for c in ("precision_macro", "recall_macro", "f1_macro")) + " from summary",
    "summary",
)
prf = ", ".join(f"{r6(c)} as {c}" for c in ("precision", "recall", "f1"))
ask("class_report", f"select cast(class as bigint) as class, {prf}, support from report", "report")
ask("report_averages", f"select average, {prf}, support from averages", "averages")
ask("topk_accuracy", f"select {r6('top3_accuracy')} as top3_accuracy from summary", "summary")
ask("mrr", f"select {r6('mrr')} as mrr from summary", "summary")
SEVEN = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "top3_accuracy", "precision_at_3", "mrr")
ask("metrics_summary", "select " + ", ".join(f"{r6(c)} as {c}" for c in SEVEN) + " from summary", "summary")
entries = [f"select 'test_metrics' as section, '{c}' as name, {c} as value from summary" for c in SEVEN]
for c in ("precision", "recall", "f1", "support"):
    entries.append(f"select 'classifier_report', class || '.{c}', {c} from report")
    entries.append(f"select 'classifier_report', average || '.{c}', {c} from averages")
entries.append("select 'clustering', 'silhouette_score', silhouette from silhouettes")
entries.append("select 'clustering', 'n_clusters', 10")
entries.append("select 'resume_index', 'n_resumes', count(*) from embeddings")
ask(
    "evaluation_report",
    f"select section, name, {r6('cast(value as double)')} as value from ({' union all '.join(entries)})",
    "summary",
    "silhouettes",
)

# ---- decisions and scores --------------------------------------------------------------------

cte(
    "everyone",
    "select k as doc_id, out from doc_clean union all select -k - 1, out from job_clean",
    "doc_clean",
    "job_clean",
)
cte(
    "every_skill",
    "select doc_id, skill from doc_skill union all select -job_id - 1, skill from job_skill",
    "doc_skill",
    "job_skill",
)
evidence_ctes("every", "everyone", "every_skill", "everyone")
cte(
    "two_best",
    f"""select doc_id, max(case when rank = 1 then {class_name} end) as d1, max(case when rank = 1 then p end) as p1,
      max(case when rank = 2 then {class_name} end) as d2, max(case when rank = 2 then p end) as p2,
      string_agg({class_name}, '|' order by rank) filter (rank <= 3) as top_domains
    from pred_rank group by doc_id""",
    "pred_rank",
)
cte(
    "facts",
    r"""select e.doc_id, b.d1, b.p1, b.d2, b.p2, b.top_domains, s.domain as skill_domain, s.score as skill_score,
      length(e.out) as n_chars, coalesce(list_max(list_transform(
        regexp_extract_all(lower(e.out), '\b(\d{1,2})\s*\+?\s*years\b', 1), lambda d: cast(d as bigint))), 0) as years,
      b.d1 is not null as known, coalesce(b.p1 - b.p2 < 0.10::double, false) as is_close,
      coalesce(s.score >= 0.75::double and s.domain <> b.d1, false) as overridden
    from everyone e left join every_best_domain s on s.doc_id = e.doc_id and s.rank = 1
    left join two_best b on b.doc_id = case when e.doc_id >= 0 then e.{DOC_VEC} end""",
    "everyone",
    "every_best_domain",
    "two_best",
)


def six(x):
    return f"cast(cast(floor({x} * 1000000 + 0.5) as bigint) as varchar)"


cte(
    "decisions",
    f"""select *, case when not known then 'Unknown' when overridden then skill_domain else d1 end as primary_domain,
      case when not known then 0 else greatest(least(case when n_chars < 300 then least(p_y, 0.5::double) else p_y end, 1), 0) end as confidence,
      coalesce(case when known then concat_ws('|', case when overridden then d1 || '=' || {six('p1')} end,
        case when is_close and d2 <> case when overridden then skill_domain else d1 end then d2 || '=' || {six('p2')} end) end, '') as secondary,
      case when not known then 'No ML probabilities available.' else concat_ws(' ',
        'ML top-1 domain: ' || d1 || ' (p=' || {f3('p1')} || ').',
        case when is_close then 'Top-2 close (gap=' || {f3('p1 - p2')} || ') => multi-domain candidate: ' || d2 || '.' end,
        'Skill-evidence top domain: ' || skill_domain || ' (score=' || {f3('skill_score')} || ').',
        case when overridden then 'High skill evidence conflicts with ML top-1 => reducing confidence and promoting secondary domain.' end,
        case when years = 0 then 'Experience years not detected; applying mild uncertainty.' end,
        case when n_chars < 300 then 'Resume text is short; capping confidence.' end) end as trace
    from (select *, case when years = 0 then p_o * 0.95::double else p_o end as p_y
      from (select *, case when overridden then greatest(p1 * 0.8::double, 0.05::double) else p1 end as p_o from facts))""",
    "facts",
)
ask("multi_domain", "select doc_id, cast(is_close as bigint) as is_multi, secondary from decisions where doc_id >= 0", "decisions")
ask("evidence_override", "select doc_id, cast(overridden as bigint) as overridden, primary_domain from decisions where doc_id >= 0", "decisions")
ask("decision_trace", "select doc_id, trace from decisions", "decisions")
ask("decide", f"select doc_id, primary_domain, secondary, {r6('confidence')} as confidence, years from decisions", "decisions")

cte("blank", f"select k as doc_id from doc_raw where {strip('raw')} = ''", "doc_raw")
cte(
    "scored",
    """select m.*, d.p1, d.primary_domain, d.secondary, d.confidence, d.trace, d.top_domains,
      case when c.out = '' then 0::double else 0.7::double end as alpha, (m.similarity + 1.0::double) / 2.0::double as component,
      case when c.out = '' then 0::double else 0.7::double end * ((m.similarity + 1.0::double) / 2.0::double) + 0.3::double * d.p1 as suitability
    from matches m join decisions d on d.doc_id = m.doc_id join job_clean c on c.k = m.job_id
    where m.doc_id not in (select doc_id from blank)""",
    "matches",
    "decisions",
    "job_clean",
    "blank",
)
cte(
    "rejected",
    "select doc_id, job_id, 'Document is unknown or has no text' as reason from requests where doc_id in (select doc_id from blank)",
    "requests",
    "blank",
)
cte(
    "banded",
    """select *, case when suitability >= 0.75::double then 'Strong Match' when suitability >= 0.55::double then 'Partial Match'
      else 'Weak Match' end as match_strength from scored""",
    "scored",
)
ask(
    "suitability",
    f"""select doc_id, job_id, {r6('component')} as component, alpha, {r6('suitability')} as suitability from scored
    union all select doc_id, job_id, null, null, null from rejected""",
    "scored",
    "rejected",
)
ask(
    "match_strength",
    "select doc_id, job_id, match_strength from banded union all select doc_id, job_id, null from rejected",
    "banded",
    "rejected",
)
cte(
    "flat_known",
    f"""select b.doc_id, b.job_id, {r6('suitability')} as suitability, match_strength, {r6('similarity')} as similarity, alpha,
      {r6('p1')} as max_p, top_domains, primary_domain, secondary, {r6('confidence')} as confidence, trace, s.skills, matched,
      missing, explanation, l.summary_len, l.experience_len, l.skills_len
    from banded b join doc_skills s on s.doc_id = b.doc_id join doc_lengths l on l.doc_id = b.doc_id""",
    "banded",
    "doc_skills",
    "doc_lengths",
)
cte(
    "flat",
    "select *, cast(null as varchar) as reason from flat_known union all by name select * from rejected",
    "flat_known",
    "rejected",
)
ranked("top_index_jobs", "job_vec", "job_id", "v", "vecs", "vec_id")
ask(
    "screen_pairs",
    """select f.*, case when f.reason is null then cast(a.cluster_id as bigint) end as cluster_id, j.ids as jd_ranked_docs,
      case when f.reason is null then v.ids end as similar_docs
    from flat f join assigned a on a.vec_id = f.{DOC_VEC}
    left join (select job_id, string_agg(cast(vec_id as varchar), '|' order by rank) as ids from top_index_jobs group by job_id) j on j.job_id = f.job_id
    left join (select query_id, string_agg(cast(vec_id as varchar), '|' order by rank) as ids from top_vecs group by query_id) v on v.query_id = f.{DOC_VEC}""",
    "flat",
    "assigned",
    "top_index_jobs",
    "top_vecs",
)
ORACLE["stream_screen"] = ORACLE["screen_pairs"]
ask(
    "shortlist",
    f"""select job_id, rank, doc_id, {r6('suitability')} as suitability, match_strength from (
      select *, row_number() over (partition by job_id order by suitability desc, doc_id) as rank from banded) where rank <= 5""",
    "banded",
)

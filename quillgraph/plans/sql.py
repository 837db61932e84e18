"""SQL fragments shared by the equivalents."""

from __future__ import annotations

from ..functions.words import STOP_WORDS


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = quoted(STOP_WORDS)


def norm_a(col: str) -> str:
    bare = f"regexp_replace(lower(coalesce({col}, '')), '\\p{{Nd}}+', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def norm_b(col: str) -> str:
    low = f"lower(coalesce({col}, ''))"
    return f"trim(regexp_replace(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def tok(name="tok", source="documents", id_col="doc_id", text="text", stop=STOP, min_len=1, rule="a", extra=""):
    """CTE ``name(doc_id, pos, term)``; ``pos`` counts kept words from 0."""
    normal = norm_a(text) if rule == "a" else norm_b(text)
    keep = f"AND term NOT IN ({stop})" if stop else ""
    more = f", {extra}" if extra else ""
    return f"""{name} AS (
      SELECT doc_id{more}, row_number() OVER (PARTITION BY doc_id ORDER BY raw_pos) - 1 AS pos, term FROM (
        SELECT doc_id{more}, unnest(ws) AS term, generate_subscripts(ws, 1) AS raw_pos
        FROM (SELECT {id_col} AS doc_id{more}, string_split({normal}, ' ') AS ws FROM {source}))
      WHERE length(term) >= {max(min_len, 1)} {keep})"""


def counts(name="tf", source="tok"):
    return f"{name} AS (SELECT doc_id, term, count(*) AS tf FROM {source} GROUP BY ALL)"


def vocab(name="vocab", source="tf", docs="documents", min_df=1, max_df=1.0, max_features=None):
    top = f"ORDER BY cf DESC, term LIMIT {max_features}" if max_features else ""
    return f"""{name} AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {source} GROUP BY term
      HAVING count(*) >= {min_df} AND count(*) <= {max_df}::DOUBLE * (SELECT count(*) FROM {docs}) {top})"""


def tfidf(name="idx", source="tf", vocab="vocab", docs="documents", use_idf=True):
    idf = f"(ln((1.0 + (SELECT count(*) FROM {docs}))::DOUBLE / (1.0 + df)::DOUBLE) + 1.0::DOUBLE)" if use_idf else "1.0::DOUBLE"
    return f"""{name}_raw AS (SELECT doc_id, term, tf, tf * {idf} AS raw FROM {source} JOIN {vocab} USING (term)),
    {name} AS (SELECT doc_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM {name}_raw)"""


def index(min_df=5, max_df=0.95, max_features=None, use_idf=True, **tok_args):
    """CTEs up to ``idx(doc_id, term, tf, w)`` over ``documents``."""
    return ",\n".join([
        tok(**tok_args), counts(),
        vocab(min_df=min_df, max_df=max_df, max_features=max_features), tfidf(use_idf=use_idf),
    ])


def query_weights(use_idf=True, source="benchmark", id_col="item_id", stop=STOP, rule="a", min_len=1, prefix="q"):
    """CTEs up to ``q(doc_id, term, tf, w)``: query vectors on the index vocabulary."""
    return ",\n".join([
        tok(f"{prefix}_tok", source, id_col, "text", stop, min_len, rule),
        counts(f"{prefix}_tf", f"{prefix}_tok"),
        tfidf(prefix, f"{prefix}_tf", use_idf=use_idf),
    ])

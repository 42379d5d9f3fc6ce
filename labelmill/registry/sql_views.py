"""The views of :mod:`views` as SQL, composed into ``WITH`` queries."""

from __future__ import annotations

import re

from labelmill.functions.taxonomy import CODE_TO_LABEL, LABELS
from labelmill.functions.text import WHITESPACE
from labelmill.registry.views import CODES, LANG_CODES


def h(text: str) -> str:
    return f"cast(concat('0x', substr(md5({text}), 1, 8)) as bigint)"


def clean(col: str) -> str:
    no_url = f"regexp_replace({col}, 'http[^{WHITESPACE}]+', '', 'g')"
    return f"coalesce(trim(regexp_replace({no_url}, '[{WHITESPACE}]+', ' ', 'g')), '')"


def split_of(key: str, seed: int = 42) -> str:
    band = f"{h(f'''concat('{seed}:', {key})''')} % 10000"
    return f"case when {band} < 8000 then 'train' when {band} < 9000 then 'val' else 'test' end"


def _values(rows) -> str:
    def lit(x):
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x + "'"

    return "VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


_LANG_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in sorted(LANG_CODES.items()))
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"

VIEWS = {
    "codes(idx, code, label)": _values(
        [(i, c, CODE_TO_LABEL.get(c)) for i, c in enumerate(CODES)]
    ),
    "label_dim(idx, label)": _values(list(enumerate(LABELS))),
    "order_codes": f"""
        SELECT l_orderkey, string_agg(code, ' ' ORDER BY code) AS cats
        FROM (SELECT DISTINCT l_orderkey, code FROM lineitem JOIN codes
              ON idx = ((l_partkey % 200) * (l_partkey % 200) * {len(CODES)}) // 40000)
        GROUP BY l_orderkey""",
    "catalog_raw": f"""
        SELECT cast(o_orderkey AS varchar) AS id,
               concat(o_orderpriority, ' ', o_orderstatus) AS title,
               coalesce(cats, 'cs.OH') AS categories, {_DAY} AS update_date
        FROM orders LEFT JOIN order_codes ON l_orderkey = o_orderkey""",
    "catalog_codes": """
        SELECT id, unnest(string_split(categories, ' ')) AS code FROM catalog_raw""",
    "catalog_labels": """
        SELECT DISTINCT id, label FROM catalog_codes JOIN codes USING (code)
        WHERE label IS NOT NULL""",
    "catalog": f"""
        SELECT c.id, c.title, c.categories, c.update_date, coalesce(n, 0) AS n_labels,
               coalesce(labels, '') AS labels, {split_of('c.id')} AS split
        FROM catalog_raw c LEFT JOIN (
            SELECT id, count(*) AS n, string_agg(label, '|' ORDER BY label) AS labels
            FROM catalog_labels GROUP BY id) l ON l.id = c.id""",
    "cells": f"""
        SELECT g.id, g.split, g.idx, g.label, g.y,
               cast(200 + 3500 * g.y + (6 * g.u) // 10 AS double) / 10000 AS prob
        FROM (SELECT c.id, c.split, d.idx, d.label,
                     case when l.id IS NULL then 0 else 1 end AS y,
                     {h("concat('7:', c.id)")} % (10007 + 2 * d.idx) % 10000 AS u
              FROM catalog c CROSS JOIN label_dim d
              LEFT JOIN catalog_labels l ON l.id = c.id AND l.label = d.label) g""",
    "logits": "SELECT *, ln(prob / (1 - prob)) AS logit FROM cells",
    "label_thresholds": """
        SELECT label, round(sum(cast(round(prob * 10000) AS bigint)) / count(*) / 10000, 4)
               AS threshold
        FROM cells WHERE y = 1 AND label NOT LIKE 'Q%' GROUP BY label""",
    "threshold_dim": """
        SELECT idx, d.label, coalesce(threshold, cast(0.5 AS double)) AS threshold
        FROM label_dim d LEFT JOIN label_thresholds t ON t.label = d.label""",
    "tags": """
        SELECT c.*, threshold, prob > threshold AS p FROM cells c JOIN threshold_dim USING (idx)""",
    "tagged": """
        SELECT id, coalesce(string_agg(t.label, '|' ORDER BY t.idx) FILTER (p), '') AS predicted,
               coalesce(string_agg(t.label, '|' ORDER BY t.idx) FILTER (y = 1), '') AS truth,
               count(*) FILTER (p) AS n_tags, count(*) FILTER (p AND y = 1) AS n_right
        FROM tags t GROUP BY id""",
    "counts": """
        SELECT idx, any_value(label) AS label,
               count(*) FILTER (y = 1 AND prob > cast(0.5 AS double)) AS tp,
               count(*) FILTER (y = 0 AND prob > cast(0.5 AS double)) AS fp,
               count(*) FILTER (y = 1 AND NOT prob > cast(0.5 AS double)) AS fn,
               count(*) FILTER (y = 1) AS support
        FROM cells GROUP BY idx""",
    "prf": """
        SELECT *, case when tp + fp = 0 then 0 else tp / (tp + fp) end AS precision,
               case when tp + fn = 0 then 0 else tp / (tp + fn) end AS recall,
               case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end AS f1
        FROM counts""",
    "papers_source": f"""
        SELECT cast(doc_id AS varchar) AS id, string_split(text, chr(10))[1] AS title,
               concat(text, ' http://example.com/', doc_id) AS abstract,
               case when source = 'src19' then 'cs.OH'
                    else concat_ws(' ', case lang {_LANG_CASE} end, cats) end AS categories,
               c_name AS authors, {_DAY} AS update_date, source
        FROM documents LEFT JOIN orders ON o_orderkey = doc_id
        LEFT JOIN order_codes ON l_orderkey = doc_id
        LEFT JOIN customer ON c_custkey = o_custkey""",
    "base": f"""
        SELECT id, {clean('title')} AS title, {clean('abstract')} AS abstract, categories,
               authors, update_date, source
        FROM papers_source""",
    "paper_labels": """
        SELECT DISTINCT id, label FROM (
            SELECT id, unnest(string_split(categories, ' ')) AS code FROM papers_source)
        JOIN codes USING (code) WHERE label IS NOT NULL""",
    "papers": f"""
        SELECT b.*, labels, {split_of('b.id')} AS split
        FROM base b JOIN (SELECT id, string_agg(label, '|' ORDER BY label) AS labels
                          FROM paper_labels GROUP BY id) l ON l.id = b.id""",
    "all_papers": f"""
        SELECT b.*, coalesce(labels, '') AS labels, labels IS NOT NULL AS labelled,
               {split_of('b.id')} AS split
        FROM base b LEFT JOIN (SELECT id, string_agg(label, '|' ORDER BY label) AS labels
                               FROM paper_labels GROUP BY id) l ON l.id = b.id""",
    "all_tokens": """
        SELECT DISTINCT id, token FROM (
            SELECT id, unnest(string_split(lower(concat(title, ' ', abstract)), ' ')) AS token
            FROM all_papers) WHERE token <> ''""",
    "truth": """
        SELECT p.id, p.split, d.idx, d.label, case when l.id IS NULL then 0 else 1 end AS y
        FROM papers p CROSS JOIN label_dim d
        LEFT JOIN paper_labels l ON l.id = p.id AND l.label = d.label""",
    "words": """
        SELECT id, split, unnest(string_split(lower(concat(title, ' ', abstract)), ' ')) AS token
        FROM papers""",
    "tokens": "SELECT DISTINCT id, split, token FROM words WHERE token <> ''",
    "class_counts": """
        SELECT idx, any_value(label) AS label, cast(count(*) AS double) AS n,
               cast(sum(y) AS double) AS pos
        FROM truth WHERE split = 'train' GROUP BY idx""",
    "inside": """
        SELECT token, label, count(*) AS c FROM tokens t JOIN paper_labels l ON l.id = t.id
        WHERE split = 'train' GROUP BY token, label""",
    "weights": """
        SELECT f.token, f.df, k.idx, k.label,
               ln((coalesce(c, 0) + 1) / (pos + 2))
               - ln((f.df - coalesce(c, 0) + 1) / (n - pos + 2)) AS w
        FROM (SELECT token, count(*) AS df FROM tokens WHERE split = 'train'
              GROUP BY token) f
        CROSS JOIN class_counts k
        LEFT JOIN inside i ON i.token = f.token AND i.label = k.label""",
    "bias": """
        SELECT idx, label, ln((pos + 1) / (n - pos + 1))
               + case when n > pos then ln(sqrt((n - pos) / greatest(pos, 1))) else 0 end AS b
        FROM class_counts""",
    "linear_scores": """
        SELECT p.id, p.split, p.labelled, s.idx, s.label,
               case when l.id IS NULL then 0 else 1 end AS y, s.logit,
               1 / (1 + exp(-s.logit)) AS prob
        FROM all_papers p JOIN (
            SELECT g.id, g.idx, g.label,
                   round(coalesce(sw, 0) / greatest(sqrt(coalesce(nw, 0)), 1) + b, 9) AS logit
            FROM (SELECT id, idx, label, b FROM all_papers CROSS JOIN bias) g
            LEFT JOIN (SELECT id, idx, sum(w) AS sw, count(*) AS nw
                       FROM all_tokens JOIN weights USING (token) GROUP BY id, idx) m
            ON m.id = g.id AND m.idx = g.idx) s ON s.id = p.id
        LEFT JOIN paper_labels l ON l.id = p.id AND l.label = s.label""",
    "val_points": """
        SELECT idx, any_value(label) AS label, prob, sum(y) AS tp, count(*) AS n
        FROM linear_scores WHERE split = 'val' AND labelled GROUP BY idx, prob""",
    "val_curve": """
        SELECT *, 2 * precision * recall / (precision + recall + cast(1e-8 AS double)) AS f1
        FROM (SELECT idx, label, prob, ctp / cn AS precision,
                     case when pos = 0 then 1 else ctp / pos end AS recall
              FROM (SELECT *, sum(tp) OVER (PARTITION BY idx ORDER BY prob DESC) AS ctp,
                           sum(n) OVER (PARTITION BY idx ORDER BY prob DESC) AS cn,
                           sum(tp) OVER (PARTITION BY idx) AS pos FROM val_points))""",
    "tuned": """
        SELECT idx, label, round(prob, 4) AS threshold, round(f1, 4) AS f1,
               round(precision, 4) AS precision, round(recall, 4) AS recall
        FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY f1 DESC, prob) AS rn
              FROM val_curve) WHERE rn = 1""",
    "vocab": """
        SELECT token, token_id, cast(n AS bigint) AS n FROM (VALUES ('[PAD]', 0, 0), ('[UNK]', 1, 0), ('[CLS]', 2, 0),
                                               ('[SEP]', 3, 0)) m(token, token_id, n)
        UNION ALL
        SELECT token, cast(row_number() OVER (ORDER BY n DESC, token) + 3 AS integer), n
        FROM (SELECT token, count(*) AS n FROM words WHERE token <> '' AND split = 'train'
              GROUP BY token)""",
    "sides": """
        SELECT id, split, list_filter(string_split(lower(title), ' '), lambda w: w <> '') AS t,
               list_filter(string_split(lower(abstract), ' '), lambda w: w <> '') AS a
        FROM papers""",
    "kept": """
        SELECT *, case when nt + na <= 509 then nt
                       when nt <= na then least(nt, 254)
                       when na <= 254 then greatest(509 - na, 0) else 255 end AS kt,
               case when nt + na <= 509 then na
                    when na < nt then least(na, 254)
                    when nt <= 254 then greatest(509 - nt, 0) else 255 end AS ka
        FROM (SELECT *, len(t) AS nt, len(a) AS na FROM sides)""",
    "sequences": """
        SELECT id, split, kt + 2 AS first_len,
               list_concat(list_concat(['[CLS]'], list_concat(t[1:kt], ['[SEP]'])),
                           list_concat(a[1:ka], ['[SEP]'])) AS seq
        FROM kept""",
    "encoded_tokens": """
        SELECT s.id, s.split, s.first_len, s.pos, coalesce(v.token_id, 1) AS token_id,
               coalesce(v.token, '[UNK]') AS token
        FROM (SELECT id, split, first_len, unnest(seq) AS token,
                     generate_subscripts(seq, 1) AS pos FROM sequences) s
        LEFT JOIN vocab v ON v.token = s.token""",
    "records": """
        SELECT case source when 'src0' then NULL when 'src1' then '' else p.id end AS id,
               case source when 'src0' then concat('a', p.id) when 'src1' then '' end AS arxiv_id,
               case source when 'src1' then concat('p', p.id) end AS paper_id,
               case source when 'src2' then '   ' when 'src3' then NULL else title end AS title,
               case source when 'src4' then NULL else abstract end AS abstract,
               case source when 'src5' then NULL else coalesce(labels, '') end AS labels,
               p.id AS paper
        FROM papers_source p LEFT JOIN (
            SELECT id, string_agg(label, '|' ORDER BY label) AS labels
            FROM paper_labels GROUP BY id) l ON l.id = p.id""",
    "shaped": f"""
        SELECT coalesce(nullif(id, ''), nullif(arxiv_id, ''), nullif(paper_id, '')) AS id,
               coalesce(title, '') AS title, coalesce(abstract, '') AS abstract, labels, paper,
               case when title IS NULL then 'missing title'
                    when regexp_matches(title, '^[{WHITESPACE}]*$') then 'blank title' end
               AS reject_reason
        FROM records""",
    "record_words": f"""
        SELECT DISTINCT paper, unnest(string_split(
            lower(concat({clean('title')}, ' ', {clean('abstract')})), ' ')) AS token
        FROM shaped""",
    "record_scores": """
        SELECT g.paper, g.idx, g.label,
               1 / (1 + exp(-round(coalesce(sw, 0) / greatest(sqrt(coalesce(nw, 0)), 1) + b, 9)))
               AS prob
        FROM (SELECT paper, idx, label, b FROM shaped CROSS JOIN bias) g
        LEFT JOIN (SELECT paper, idx, sum(w) AS sw, count(*) AS nw
                   FROM record_words JOIN weights USING (token) GROUP BY paper, idx) m
        ON m.paper = g.paper AND m.idx = g.idx""",
    "record_tags": """
        SELECT s.id, s.title, s.labels AS true_tags, s.reject_reason,
               coalesce(string_agg(r.label, '|' ORDER BY r.idx) FILTER (prob > 0.5), '')
               AS predicted
        FROM shaped s JOIN record_scores r ON r.paper = s.paper
        GROUP BY s.paper, s.id, s.title, s.labels, s.reject_reason""",
    "train_log": """
        SELECT cast(user_id AS varchar) AS run, event_id AS step,
               case when event_type <> 'purchase' then sqrt(value) end AS loss,
               case when event_type <> 'purchase' then value / 1000 end AS learning_rate,
               case when event_type = 'purchase' then value end AS eval_loss,
               case when event_type = 'purchase' then value / (value + 1) end AS eval_f1,
               case when event_type = 'purchase' then value / (value + 2) end AS eval_f1_weighted,
               case when event_type = 'purchase' then value / (value + 3) end AS eval_precision,
               case when event_type = 'purchase' then value / (value + 4) end AS eval_recall
        FROM events""",
    "log_order": """
        SELECT run, step, loss, row_number() OVER (PARTITION BY run ORDER BY step) AS rn
        FROM train_log WHERE loss IS NOT NULL""",
    "ema": """
        SELECT run, step, loss, loss AS ema, rn FROM log_order WHERE rn = 1
        UNION ALL
        SELECT o.run, o.step, o.loss, 0.05 * o.loss + 0.95 * e.ema, o.rn
        FROM ema e JOIN log_order o ON o.run = e.run AND o.rn = e.rn + 1""",
}

_NAMES = {v.split("(")[0]: v for v in VIEWS}


def _needs(text: str) -> set[str]:
    return {n for n in _NAMES if re.search(rf"(?<![.\w']){n}(?![\w'(])", text)}


def sql(body: str) -> str:
    """``body`` with every view it uses, directly or not, as a ``WITH`` list."""
    wanted, todo = set(), _needs(body)
    while todo:
        name = todo.pop()
        wanted.add(name)
        todo |= _needs(VIEWS[_NAMES[name]]) - wanted
    parts = [f"{v} AS ({VIEWS[v].strip()})" for n, v in _NAMES.items() if n in wanted]
    return f"WITH RECURSIVE {', '.join(parts)} {body.strip()}" if parts else body.strip()

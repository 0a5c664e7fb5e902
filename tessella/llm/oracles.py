"""DuckDB SQL with the same rows as those queries of the operators that SQL can express."""

from __future__ import annotations

from . import chat, rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for k, mark in enumerate(chat.CONTROL):
        out = f"replace({out}, '{mark}', chr(92) || 'c{k};')"
    return out


def chat_sql() -> str:
    """All control strings are escaped one after the other: none is part of another or of an escape."""
    frame = len(chat.START) + 1 + len(chat.END)
    return f"""
    with turns as (
        select conv_id, turn, role, coalesce(text, '') as text from conversations
        union all select -7, k, role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(k, role)
    )
    select conv_id, count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
           cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
           cast(sum(length(role) + {frame} + length({_escaped("text")})) as bigint) as formatted_chars
    from turns group by conv_id
    """


def substrings_sql() -> str:
    return f"""
    with lists as (select doc_id, {_WORDS} as w from documents),
    words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos, w from lists where len(w) > 0),
    windows as (
        select doc_id, pos, row_number() over (partition by array_to_string(list_slice(w, pos, pos + 19), ' ') order by doc_id, pos) as nth
        from words where pos + 19 <= len(w)
    ),
    ends as (select doc_id, pos from windows where nth > 1),
    marked as (
        select a.doc_id, a.word, a.pos,
               max(b.pos) over (partition by a.doc_id order by a.pos rows between unbounded preceding and current row) as last
        from words a left join ends b on a.doc_id = b.doc_id and a.pos = b.pos
    ),
    left_over as (
        select doc_id, count(*) filter (where last is null or pos - last >= 20) as n,
               string_agg(word, ' ' order by pos) filter (where last is null or pos - last >= 20) as kept
        from marked group by doc_id
    )
    select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(k.n, 0) as bigint) as n_removed,
           sha256(coalesce(k.kept, '')) as kept_sha256
    from lists d left join left_over k on d.doc_id = k.doc_id
    """


def rules_sql() -> str:
    """The verdict tests the same cutoffs: the binomial tail is summed over its terms from log-gamma."""
    tests = " union all ".join(f"select '{s}' as signal, cast({c} as double) as cutoff" for s, cuts in rules.GRID.items() for c in cuts)
    part = rules.RISK / len(rules.GRID)
    return f"""
    with base as (
        select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, {_WORDS} as w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
        from documents
    ),
    windows as (
        select doc_id, pos, count(*) over (partition by doc_id, array_to_string(list_slice(w, pos, pos + 7), ' ')) as times
        from (select doc_id, w, unnest(range(1, len(w) - 6)) as pos from base where len(w) >= 8)
    ),
    runs as (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from windows where times > 1),
    covered as (select doc_id, sum(case when before is null then 8 else least(8, pos - before) end) as n from runs group by doc_id),
    feats as (
        select b.doc_id, stratum, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
               length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) as n_upper,
               len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
        from base b left join covered c on b.doc_id = c.doc_id
    ),
    signals as (
        select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
               n_symbols / greatest(word_chars, 1) as symbol_share, n_upper / greatest(word_chars, 1) as upper_share,
               n_dup_lines / greatest(n_lines, 1) as dup_line_share, n_repeat_words / greatest(n_words, 1) as repeat_share
        from feats
    ),
    long as (unpivot signals on symbol_share, upper_share, dup_line_share, repeat_share into name signal value v),
    tests as ({tests}),
    good as (select doc_id, min(quality) as good from labels where quality is not null group by doc_id),
    counted as (
        select stratum, l.signal, cutoff, count(*) filter (where good = 1) as n, count(*) filter (where good = 1 and v > cutoff) as k,
               count(*) filter (where good <> 1) as n_bad, count(*) filter (where good <> 1 and v > cutoff) as hits
        from long l join good g on l.doc_id = g.doc_id join tests t on l.signal = t.signal
        where not base_failed group by stratum, l.signal, cutoff
    ),
    tails as (
        select *, list_sum(list_transform(range(0, k + 1), lambda j: exp(
                   lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({part}) + (n - j) * ln(1 - {part})))) as tail
        from counted where n > 0 and k < n * {part}
    ),
    cut as (
        select stratum, signal, arg_max(cutoff, hits * 1000 + cutoff) as cutoff from tails
        where tail <= {rules.DELTA} / (select greatest(1, count(*)) from counted) and hits * n > k * n_bad group by stratum, signal
    ),
    rejected as (select distinct l.doc_id from long l join cut c on l.stratum = c.stratum and l.signal = c.signal and v > cutoff)
    select s.doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
           cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
           not base_failed and r.doc_id is null as kept
    from signals s left join rejected r on s.doc_id = r.doc_id
    """


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat_sql(), "op7_substrings": substrings_sql(), "op8_rules": rules_sql()}

"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, importance, language_id, licences, line_dedup, mixture, repeats, simhash, url_filter, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4).select("doc_id", "fingerprint", "component_id")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=200)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    one_more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(one_more)
    return chat.digests(chat.read_back(chat.format_chats(chat.table_log(turns))))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, min_words=20)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_warc, op3_line_dedup, op4_simhash, op5_repeats, op6_decontaminate, op7_url_filter, op8_licence_scan, op9_mixture, op10_exact_dedup, op11_chat_format, op12_importance, op13_whitening)
}

#: The Base32 digits of a SHA-1 digest in hex: each group of five hex digits makes four.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TOKENS = f"list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '{_BETWEEN}'), lambda w: w <> '')"
_URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_URL_CASES = sorted(_URL_RULES, key=lambda r: -len(r[0] + r[1]))
_FITS = "(host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '{1}')"

#: The rest of every control string of the chat template after its first character, and the crc32 of w, bit by bit.
_GUARDED = r"([<\[])(\\*(?:\|endoftext\|>|\|im_start\|>|\|im_sep\|>|\|im_end\|>|/INST\]|INST\]|/s>|s>))"
_ESCAPED = f"length(regexp_replace({{}}, '{_GUARDED}', '\\1\\\\\\2', 'g'))"
_BITS = "list_transform(range(4 * length(h)), lambda i: (('0x' || substr(h, 1 + 2 * (i // 8)::INT, 2))::INT >> (i % 8)::INT) & 1)"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BITS}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT)"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": f"""
        with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) hex from pages)
        select page_id, strlen(html)::BIGINT payload_bytes, {_BASE32} payload_digest,
            case when page_id = max(page_id) over (partition by html) then 'response' else 'revisit' end record_type,
            case when page_id <> max(page_id) over (partition by html) then max(page_id) over (partition by html) end refers_to
        from p""",
    "op3_line_dedup": rf"""
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
        k as (select *, {_LOWER.format(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} key from l),
        r as (select key, max(doc_id) keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
        j as (select k.*, (r.key is not null and k.doc_id <> r.keeper) gone from k left join r using (key))
        select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
        from j group by doc_id""",
    "op6_decontaminate": f"""
        with d as (select doc_id, {_TOKENS} w from documents),
        b as (select item_id, {_TOKENS} w from benchmark),
        bw as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') x from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
        dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') x from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw) where len(w) >= n)),
        h as (select doc_id, i, dw.n, item_id from dw join bw using (n, x)),
        hits as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from h) group by doc_id),
        items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item_id::VARCHAR item from h) group by doc_id)
        select d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from d left join hits using (doc_id) left join items using (doc_id)""",
    "op7_url_filter": rf"""
        with p as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
        q as (select page_id, {_LOWER.format(r"regexp_extract(rest, '^[^/?#]*', 0, 's')")} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') path from p)
        select page_id, host, path,
            case {" ".join(f"when {_FITS.format(h, p)} then '{h}{p}'" for h, p, _ in _URL_CASES)} end rule,
            case {" ".join(f"when {_FITS.format(h, p)} then '{v}'" for h, p, v in _URL_CASES)} else 'allow' end verdict
        from q""",
    "op10_exact_dedup": f"""
        with d as (select doc_id, {_LOWER.format("coalesce(text, '')")} t from documents)
        select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
            row_number() over (partition by t order by doc_id desc) = 1 kept, sha256(t) text_sha256
        from d""",
    "op11_chat_format": f"""
        with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') t from conversations
            union all select -1, i, case i when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(i)),
        g as (select conv_id, count(*) n, string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t) s, coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), '') a,
            sum({_ESCAPED.format("role")} + {_ESCAPED.format("t")} + {len("<|im_start|><|im_sep|><|im_end|>")}) f from c group by conv_id)
        select conv_id, n n_turns, sha256(s) turns_sha256, length(a) loss_chars, sha256(a) loss_sha256, f::BIGINT formatted_chars from g""",
    "op12_importance": f"""
        with d as (select doc_id, {_TOKENS} w from documents), dw as (select doc_id, unnest(w) x from d), bw as (select unnest({_TOKENS}) x from benchmark),
        v as (select x, {_CRC32} % 10000 bucket from (select x, hex(encode(x)) h from (select x from dw union select x from bw))),
        s as (select bucket, count(*) n from dw join v using (x) group by 1), t as (select bucket, count(*) n from bw join v using (x) group by 1),
        g as (select i bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((select coalesce(sum(n), 0) from s)::DOUBLE + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * ((select coalesce(sum(n), 0) from t)::DOUBLE + 10000))))::BIGINT gain
            from range(10000) r(i) left join s on s.bucket = i left join t on t.bucket = i),
        k as (select doc_id, sum(gain) weight from dw join v using (x) join g using (bucket) group by 1),
        e as (select doc_id, len(w)::BIGINT n_features, coalesce(weight, 0)::BIGINT weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT h from d left join k using (doc_id)),
        f as (select doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT score, n_features >= 20 enough from e),
        r as (select *, row_number() over (partition by enough order by score desc, doc_id nulls last, n_features) place, count(*) over (partition by enough) n from f)
        select doc_id, n_features, weight, score, case when enough and place <= 10 * n // 100 then place end rank from r""",
}

"""One registered query per operator, over its whole table, and check SQL where SQL can say it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvekit.llm import bayes, content_sort, cube, fertility, fill_middle, frames, jaccard, main_text, merkle, minhash, pieces, rendezvous, secrets
from curvekit.session import scratch_path

SHARDS = 8
END_ID = 2
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each whole text and the text decoded from them, as digests."""
    encoded = pieces.encode(table(spark, sf_dir, "documents"), PIECES)
    return pieces.digests(encoded, PIECES)


def op2_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"), PIECES)


def op4_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.main_texts(pages, main_text.fit_weights(pages))


def op6_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = secrets.identifier_strings(spark, secrets.training_words(docs))
    samples = secrets.random_strings(spark).union(secrets.ordinary_strings(docs)).union(names)
    return secrets.find_secrets(docs, secrets.train(samples))


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op8_frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    frames.write_ids(table(spark, sf_dir, "documents"), path, BYTE_BPE, END_ID)
    return frames.read_digests(spark, path)


def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = cube.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.group_equal_texts(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, half of which are found without their line ends."""
    return merkle.manifest(
        table(spark, sf_dir, "documents"),
        found={"text": F.translate("text", "\n", "")},
        suspect=F.crc32(F.col("doc_id").cast("string")) % 2 == 0,
        paths=False,
    )


def op12_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_site_bayes": op2_site_bayes,
    "op3_fertility_rules": op3_fertility_rules,
    "op4_jaccard_classes": op4_jaccard_classes,
    "op5_main_text": op5_main_text,
    "op6_secret_spans": op6_secret_spans,
    "op7_rendezvous_shards": op7_rendezvous_shards,
    "op8_frame_files": op8_frame_files,
    "op9_cube_mix": op9_cube_mix,
    "op10_content_sort": op10_content_sort,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_minhash_classes": op12_minhash_classes,
    "op13_fill_middle": op13_fill_middle,
}

def _value(column: str) -> str:
    return f"coalesce(strlen({column}::varchar)::varchar || ':' || {column}::varchar, '-')"


_LEAF = " || ".join(_value(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_ABOVE = (
    "list_transform(range(0, (len(nodes) + 2) // 3), "
    "lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))"
)
#: Siblings left and right of the node above a leaf at `place`, in the level `nodes`.
_SIDES = (
    "array_to_string(nodes[(({place} // (3 ** level)::bigint) // 3) * 3 + 1:({place} // (3 ** level)::bigint)], '') as lhs, "
    "array_to_string(nodes[({place} // (3 ** level)::bigint) + 2:(({place} // (3 ** level)::bigint) // 3) * 3 + 3], '') as rhs"
)
#: CRC-32 of the decimal doc_id: eight steps of the reflected polynomial for each of its bytes.
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, "
    "flatten(list_transform(range(1, 1 + strlen(doc_id::varchar)), "
    "lambda i: list_prepend(-1 - ascii(substr(doc_id::varchar, i, 1))::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[])))), "
    "lambda c, x: case when x < 0 then xor(c, -1 - x) when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
)

ORACLES: dict[str, str] = {
    "op10_content_sort": r"""
        with n as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm
            from documents
        ), g as (
            select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
        from n join g using (norm)""",
    "op11_merkle_manifest": rf"""
        with recursive leaves as (
            select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place
            from (
                select doc_id, source, sha256({_LEAF.format(text="text")}) as leaf,
                    coalesce(({_CRC32}) % 2 = 0, false) as suspect,
                    sha256({_LEAF.format(text="replace(text, chr(10), '')")}) as found
                from documents
            )
        ), trees as (
            select source, 0 as level, list(leaf order by place) as nodes from leaves group by source
            union all
            select source, level + 1, {_ABOVE} from trees where len(nodes) > 1
        ), ordered as (
            select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as place
            from trees where len(nodes) = 1
        ), tops as (
            select 0 as level, list(subroot order by place) as nodes from ordered
            union all
            select level + 1, {_ABOVE} from tops where len(nodes) > 1
        ), paths as (
            select doc_id, leaves.source, place, level, {_SIDES.format(place="place")}
            from leaves join trees on leaves.source is not distinct from trees.source where len(nodes) > 1
            union all
            select doc_id, leaves.source, leaves.place, 1000 + level, {_SIDES.format(place="ordered.place")}
            from leaves join ordered on leaves.source is not distinct from ordered.source cross join tops where len(nodes) > 1
        ), whole as (
            select source, place, list(lhs order by level) as lefts, list(rhs order by level) as rights from paths group by source, place
        ), folding as (
            select leaves.*, lefts, rights, 0 as step, case when suspect then found else leaf end as digest
            from leaves left join whole on leaves.source is not distinct from whole.source and leaves.place = whole.place
            union all
            select * exclude (step, digest), step + 1, sha256(lefts[step + 1] || digest || rights[step + 1])
            from folding where step < len(lefts)
        ), folded as (
            select *, list_reduce(list_prepend('', list_transform(range(1, 1 + coalesce(len(lefts), 0)), lambda i: lefts[i] || rights[i])),
                lambda x, y: x || y) as proof
            from folding where step = coalesce(len(lefts), 0)
        )
        select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, digest as folded_root, digest = root as verified
        from folded join ordered on folded.source is not distinct from ordered.source
            cross join (select nodes[1] as root from tops where len(nodes) = 1)""",
    "op12_minhash_classes": r"""
        with recursive words as (
            select doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') as w
            from documents
        ), sets as (
            select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
            from words
        ), entries as (
            select doc_id, len(s) as n, unnest(s) as shingle from sets
        ), links as (
            select a.doc_id as x, b.doc_id as y from entries a join entries b using (shingle)
            where a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach as (
            select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x
        ), least_of as (
            select x, min(y) as y from reach group by x
        )
        select doc_id, len(s) as n_shingles, least(doc_id, coalesce(y, doc_id)) as component_id,
            doc_id = least(doc_id, coalesce(y, doc_id)) as kept
        from sets left join least_of on doc_id = x""",
    "op13_fill_middle": r"""
        with tokens as (
            select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t,
                sha256('1:' || coalesce(doc_id::varchar, '')) as h
            from documents
        ), drawn as (
            select *, len(t) as n, [('0x' || substr(h, 8 * i + 1, 8))::bigint for i in range(4)] as x from tokens
        ), cut as (
            select *, least(x[1] % (n + 1), x[2] % (n + 1)) as a, greatest(x[1] % (n + 1), x[2] % (n + 1)) as b,
                case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or x[3] % 100 >= 90
                    then 'plain' when x[4] % 100 < 20 then 'spm' else 'psm' end as form
            from drawn
        ), parts as (
            select *, array_to_string(t[1:a], '') as prefix, array_to_string(t[a + 1:b], '') as middle, array_to_string(t[b + 1:], '') as suffix
            from cut
        )
        select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
            case when form <> 'plain' then length(middle) end as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
            sha256(text) as restored_sha256
        from parts""",
}

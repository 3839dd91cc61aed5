"""The numbered operators' queries and SQL, for __spark_entry__."""

from __future__ import annotations

from heddle.llm.bpe import op3_bpe
from heddle.llm.collocations import op13_collocations
from heddle.llm.language import op6_language
from heddle.llm.media import op9_media
from heddle.llm.minmax import op12_minhash
from heddle.llm.mixing import op2_mix
from heddle.llm.passages import op4_passages
from heddle.llm.quality import op5_quality
from heddle.llm.resampling import op11_resampling
from heddle.llm.secrets import op1_secrets
from heddle.llm.simhash import op8_simhash
from heddle.llm.suffixes import op7_suffixes
from heddle.llm.toxicity import op10_toxicity

QUERIES = {"op1_secrets": op1_secrets, "op2_mix": op2_mix, "op3_bpe": op3_bpe, "op4_passages": op4_passages, "op5_quality": op5_quality, "op6_language": op6_language, "op7_suffixes": op7_suffixes, "op8_simhash": op8_simhash, "op9_media": op9_media, "op10_toxicity": op10_toxicity, "op11_resampling": op11_resampling, "op12_minhash": op12_minhash, "op13_collocations": op13_collocations}
ORACLE_SQL: dict[str, str] = {
    # windows that started earlier, by rank over the window's words; whole tables, no hashing
    "op4_passages": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') w FROM documents),
 windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) i FROM d)),
 later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) r FROM windows) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, i + k p FROM later, range(20) t(k)),
 kept AS (SELECT doc_id, count(*) n, string_agg(x, ' ' ORDER BY p) s FROM (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(s, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    # 400-byte strings that occur twice or more, their runs, and the bytes between the runs
    "op7_suffixes": r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) b FROM documents),
 windows AS (SELECT doc_id, i, array_slice(b, i, i + 399) s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) i FROM d)),
 often AS (SELECT md5(s) h FROM windows GROUP BY 1 HAVING count(*) > 1),
 hit AS (SELECT doc_id, i FROM windows WHERE md5(s) IN (SELECT h FROM often)),
 runs AS (SELECT doc_id, min(i) a, max(i) + 399 z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) g FROM (SELECT *, (i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 400)::INT fresh FROM hit)) GROUP BY doc_id, g),
 gaps AS (SELECT doc_id, z, a, hex(array_slice(b, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1, a - 1)) g FROM runs JOIN d USING (doc_id)),
 sums AS (SELECT doc_id, sum(z - a + 1) n, count(*) k, max(z) z, string_agg(g, '' ORDER BY a) g FROM gaps GROUP BY 1)
 SELECT doc_id, octet_length(b)::BIGINT n_bytes, coalesce(n, 0)::BIGINT n_removed, coalesce(k, 0)::BIGINT n_spans, sha256(CASE WHEN k IS NULL THEN b ELSE unhex(g || hex(array_slice(b, z + 1, octet_length(b)))) END) kept_sha256 FROM d LEFT JOIN sums USING (doc_id)""",
    # CRC-32 by its polynomial, over each distinct word
    "op11_resampling": r"""WITH steps AS (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c FROM range(256) r(i)),
 tab AS (SELECT list(c ORDER BY i) t FROM steps),
 words AS (SELECT src, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w FROM (SELECT 's' src, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark)),
 known AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 k FROM (SELECT DISTINCT w FROM words), tab),
 n AS (SELECT k, count(*) FILTER (src = 's') s, count(*) FILTER (src = 't') t FROM words JOIN known USING (w) GROUP BY 1),
 gains AS (SELECT k, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT g FROM n),
 sums AS (SELECT doc_id, count(*) n, sum(g)::BIGINT g FROM words JOIN known USING (w) JOIN gains USING (k) WHERE src = 's' GROUP BY 1),
 scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT h FROM documents LEFT JOIN sums USING (doc_id)),
 final AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT score FROM scored),
 placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r, count(*) OVER () m FROM final WHERE n_features >= 20)
 SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * m // 100 THEN r END::BIGINT AS "rank" FROM final LEFT JOIN placed USING (doc_id)""",
    # distinct pairs of words; all pairs that share one are measured
    "op12_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) s FROM w WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
 met AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(doc_id, c) AS (SELECT a, a FROM links UNION SELECT b, b FROM links UNION SELECT b, c FROM reach JOIN either ON a = doc_id WHERE c < b),
 least AS (SELECT doc_id, min(c) c FROM reach GROUP BY 1)
 SELECT doc_id, coalesce(n, 0)::BIGINT n_shingles, coalesce(c, doc_id) component_id, coalesce(c, doc_id) = doc_id kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)""",
    # all phrases of one to three words, their counts, cuts and longer phrases; whole tables, no sketch
    "op13_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \x09]+'), lambda x: x <> '') w FROM p),
 g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') s FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) i FROM w, range(1, 4) t(m))),
 c AS (SELECT lang, m, s, count(*) f FROM g GROUP BY ALL HAVING count(*) >= 10),
 n AS (SELECT lang, sum(len(w))::BIGINT n FROM w GROUP BY 1),
 k AS (SELECT lang, m, s, f a, k, array_to_string(string_split(s, ' ')[1 : k], ' ') x, array_to_string(string_split(s, ' ')[k + 1 : m], ' ') y FROM c, range(1, 3) t(k) WHERE k < m),
 v AS (SELECT k.lang, k.m, k.s, a, l.f l, r.f r, k, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT score FROM k JOIN c l ON l.lang = k.lang AND l.s = x JOIN c r ON r.lang = k.lang AND r.s = y),
 best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
 longer AS (SELECT lang, s, max(f) f FROM (SELECT lang, f, array_to_string(string_split(s, ' ')[i : i + 1], ' ') s FROM c, range(1, 3) t(i) WHERE m = 3) GROUP BY 1, 2),
 left_ AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, s) WHERE coalesce(100 * longer.f < 50 * a, true))
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS "rank", s phrase, a, l, r, n, score FROM left_ JOIN n USING (lang) QUALIFY "rank" <= 2000""",
}

"""Placeholder labels (R2) and their localisation (R3) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims, vocab
from .binding import let


def _upper_role(role: Column, space_to_underscore: bool) -> Column:
    up = F.upper(role)
    return F.replace(up, F.lit(" "), F.lit("_")) if space_to_underscore else up


def label_for(category: Column, entity_type: Column, role: Column) -> Column:
    """R2, Italian label before localisation.

    1. person/org sub-types (birth place, nationality, birth date): dedicated
       label, ``_ROLE`` appended unless the role is empty or ``documento``;
    2. other members of the two role categories: the role verbatim (upper,
       spaces to ``_``), else PERSONA / ORGANIZZAZIONE;
    3. everything else: type label, else category label, else ENTITA, plus
       ``_ROLE`` unless empty or ``documento`` (spaces kept).
    """
    sub = dims.map_lit(vocab.PERSON_SUBTYPE_PLACEHOLDER)
    typ = dims.map_lit(vocab.TYPE_PLACEHOLDER)
    cat = dims.map_lit(vocab.BRACKET_PLACEHOLDER)
    in_role_cat = category.isin(vocab.ROLE_CATEGORIES)
    has_owner = role.isNotNull() & (role != "") & (role != vocab.OWNER_CATCH_ALL)
    has_role = role.isNotNull() & (role != "")
    base3 = F.coalesce(typ[entity_type], cat[category], F.lit("ENTITA"))
    return (
        F.when(in_role_cat & sub[entity_type].isNotNull(),
               F.when(has_owner, F.concat(sub[entity_type], F.lit("_"), _upper_role(role, True)))
               .otherwise(sub[entity_type]))
        .when(in_role_cat,
              F.when(has_role, _upper_role(role, True))
              .when(category == "persone_fisiche", F.lit("PERSONA"))
              .otherwise(F.lit("ORGANIZZAZIONE")))
        .otherwise(F.when(has_owner, F.concat(base3, F.lit("_"), _upper_role(role, False)))
                   .otherwise(base3))
    )


def _translation_map() -> Column:
    """lower Italian key -> array(en, fr, de)."""
    return dims.map_lit([(key, list(shown)) for key, *shown in vocab.LABEL_TRANSLATIONS])


def _multi_token_keys() -> list[tuple[str, int]]:
    keys = [(k, k.count("_") + 1) for k, *_ in vocab.LABEL_TRANSLATIONS if "_" in k]
    return sorted(keys, key=lambda x: x[1], reverse=True)   # stable: table order within a size


def localise(label: Column, language: Column) -> Column:
    """Translate ``label`` token by token into ``language`` (en/fr/de);
    multi-token keys match greedily first (longest key first, table order),
    unknown tokens stay verbatim; Italian and other languages are a no-op."""
    tmap = _translation_map()
    lang_idx = (F.when(language == "en", 1).when(language == "fr", 2)
                .when(language == "de", 3))
    multi = F.expr("array(" + ", ".join(f"named_struct('k', '{k}', 'n', {n})" for k, n in _multi_token_keys()) + ")")

    def translated(toks):
        def step(acc, i):
            # first multi-token key whose window at i matches
            hit = F.get(F.filter(multi, lambda m: (i + m["n"] - 1 <= F.size(toks)) & (
                F.lower(F.array_join(F.slice(toks, i, m["n"]), "_")) == m["k"])), F.lit(0))

            def placed(hit):
                single = F.element_at(tmap[F.lower(F.element_at(toks, i))], lang_idx)
                piece = F.when(hit.isNotNull(), F.element_at(tmap[hit["k"]], lang_idx)) \
                         .otherwise(F.coalesce(single, F.element_at(toks, i)))
                return F.struct((i + F.coalesce(hit["n"], F.lit(1))).alias("next"), F.array_append(acc["out"], piece).alias("out"))

            return F.when(i >= acc["next"], let(hit, placed)).otherwise(acc)

        init = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out"))
        return F.array_join(F.aggregate(F.sequence(F.lit(1), F.size(toks)), init, step)["out"], "_")

    return F.when(lang_idx.isNull(), label).otherwise(let(F.split(label, "_", -1), translated))

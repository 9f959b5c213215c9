"""The queries of the subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from chatlens.llm import chat_format, decontamination, html_template, language, mixing, quality_net, quality_rules, sharding, simhash, substrings, toxicity, treap_search, turn_repair


def queries():
    return {
        "op1_mixing": mixing.op1,
        "op2_language": language.op2,
        "op3_sharding": sharding.op3,
        "op4_simhash": simhash.op4,
        "op5_quality_net": quality_net.op5,
        "op6_html_template": html_template.op6,
        "op7_substrings": substrings.op7,
        "op8_toxicity": toxicity.op8,
        "op9_decontamination": decontamination.op9,
        "op10_quality_rules": quality_rules.op10,
        "op11_treap_search": treap_search.op11,
        "op12_turn_repair": turn_repair.op12,
        "op13_chat_format": chat_format.op13,
    }


def oracle_sql():
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op3_sharding": sharding.OP3_SQL,
        "op7_substrings": substrings.OP7_SQL,
        "op9_decontamination": decontamination.OP9_SQL,
        "op11_treap_search": treap_search.OP11_SQL,
        "op13_chat_format": chat_format.OP13_SQL,
    }

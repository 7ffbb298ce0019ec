"""Queries of this folder and their SQL."""

from __future__ import annotations

from . import op01_quality as op01
from . import op02_neighbours as op02
from . import op03_licences as op03
from . import op04_jaccard as op04
from . import op05_secrets as op05
from . import op06_substrings as op06
from . import op07_decontaminate as op07
from . import op08_html as op08
from . import op09_suffix_dedup as op09
from . import op10_pack as op10
from . import sql


def queries():
    return {
        "op1_quality": op01.op1_quality,
        "op2_neighbours": op02.op2_neighbours,
        "op3_licences": op03.op3_licences,
        "op4_jaccard": op04.op4_jaccard,
        "op5_secrets": op05.op5_secrets,
        "op6_substrings": op06.op6_substrings,
        "op7_decontaminate": op07.op7_decontaminate,
        "op8_html": op08.op8_html,
        "op9_suffix_dedup": op09.op9_suffix_dedup,
        "op10_pack": op10.op10_pack,
    }


def oracle_sql():
    return {"op3_licences": op03.oracle(), "op4_jaccard": sql.OP4, "op6_substrings": sql.OP6, "op7_decontaminate": sql.OP7}

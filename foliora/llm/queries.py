"""Queries of this subpackage, by name."""

from __future__ import annotations

from foliora.llm.bitext import p5_found
from foliora.llm.langid import p2_found
from foliora.llm.leakage import p8_found
from foliora.llm.lookalikes import p4_found
from foliora.llm.names import p3_found
from foliora.llm.packing import p7_pack
from foliora.llm.privacy import p9_found
from foliora.llm.scannoise import p6_found, p6_repaired

QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_repaired": p6_repaired, "p7_pack": p7_pack, "p8_found": p8_found, "p9_found": p9_found, "p3_found": p3_found}

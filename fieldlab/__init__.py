"""fieldlab: point-in-time sports features, probability scores, audits and text matching as Spark plans."""

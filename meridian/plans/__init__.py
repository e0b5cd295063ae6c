"""Plan-shaping helpers: region scoping, bounded broadcast, rollups through the accounts."""

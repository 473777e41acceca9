"""The questions users ask: listings, analytics, predefined reports and stored queries."""

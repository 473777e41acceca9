"""Building blocks over DataFrames: windows, filters, ranks, pages, counts, search and change-merge."""

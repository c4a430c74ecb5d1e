"""DataFrame operators: profiles, counts, curves, models, pages, run logs."""

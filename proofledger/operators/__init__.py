"""DataFrame-to-DataFrame operators: medians, windows, ordering, set differences."""

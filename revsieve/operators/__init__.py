"""DataFrame-to-DataFrame operators: rules, ranking, history, feedback, reports."""

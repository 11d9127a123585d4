"""Where rows come from and go to: event table, request log, live tables."""

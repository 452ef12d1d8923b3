"""Where rows come from: tables, datasets, documents."""

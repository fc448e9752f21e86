"""Jobs over tables of query text, manifests, pipeline events and suite documents."""

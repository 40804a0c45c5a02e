"""Search spaces, samplers and studies."""

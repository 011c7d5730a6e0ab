"""Tables and manifests that observations come from."""

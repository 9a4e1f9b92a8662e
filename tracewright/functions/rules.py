"""Rule cascades as data: (outcome, SQL predicate) in order, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names the rules test for.
CORE_WATCHED = ("configmaps", "clusterroles", "namespaces", "serviceaccounts", "resourcequotas", "clusterrolebindings", "rolebindings", "secrets", "nodes", "pods", "roles")
APISERVER, KCM, SCHEDULER = "system:apiserver", "system:kube-controller-manager", "system:kube-scheduler"
COREDNS, PROXY = "system:serviceaccount:kube-system:coredns", "system:serviceaccount:kube-system:kube-proxy"
FLANNEL, NODE_CONTROLLER = "system:serviceaccount:kube-flannel:flannel", "system:serviceaccount:kube-system:node-controller"
COLLECTORS = ("generic-garbage-collector", "resourcequota-controller")


def one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(f"'{v}'" for v in values)})"


def by(user: str) -> str:
    return f"username = '{user}'"


NODE = "username LIKE '%system:node:%'"
NODE_START = "username LIKE 'system:node:%'"
WATCH = "verb = 'watch'"

#: (decision, toggle or None, predicate)
NOISE = [
    ("removed", None, "uri IS NULL OR NOT has_ref OR uri IN ('/readyz', '/livez', '/api', '/apis', '/api/v1') OR uri LIKE '%/api?timeout%' OR uri LIKE '%/apis?timeout%' OR uri LIKE '%/openapi/v2%' OR uri LIKE '%/openapi/v3%'"),
    ("removed", None, "stage IS NULL OR stage <> 'ResponseComplete'"),
    ("removed", "response_started_watch", "verb <> 'watch' AND stage = 'ResponseStarted'"),
    ("removed", "cni_and_external_namespaces", f"namespace IN ('falco', 'kube-flannel') OR {by(FLANNEL)}"),
    ("blacklisted", "api_server_watching_objects", f"{WATCH} AND {one_of('resource', CORE_WATCHED)} AND {by(APISERVER)}"),
    ("blacklisted", "kube_controller_watching_objects", f"{WATCH} AND {one_of('resource', (*CORE_WATCHED, 'certificatesigningrequests'))} AND {by(KCM)}"),
    ("blacklisted", "kube_scheduler_watching_objects", f"{WATCH} AND resource IN ('pods', 'nodes', 'namespaces') AND {by(SCHEDULER)}"),
    ("blacklisted", "extension_apiserver_authentication", f"{WATCH} AND resource = 'configmaps' AND name = 'extension-apiserver-authentication' AND {by(SCHEDULER)}"),
    ("blacklisted", "nodes_watching_pods_and_nodes", f"{WATCH} AND resource IN ('pods', 'nodes') AND {NODE}"),
    ("blacklisted", "nodes_watching_configmaps", f"{WATCH} AND resource = 'configmaps' AND namespace = 'kube-system' AND {NODE}"),
    ("blacklisted", "nodes_creating_sas_token", f"verb = 'create' AND resource = 'serviceaccounts' AND subresource = 'token' AND {NODE}"),
    ("blacklisted", "coredns_watching_namespaces", f"{WATCH} AND resource = 'namespaces' AND {by(COREDNS)}"),
    ("blacklisted", "kube_proxy_watching_nodes", f"{WATCH} AND resource = 'nodes' AND {by(PROXY)}"),
    ("blacklisted", "nodes_getting_their_own_status", f"verb = 'get' AND resource = 'nodes' AND {NODE}"),
    ("blacklisted", "nodes_patching_their_own_status", f"verb = 'patch' AND resource = 'nodes' AND {NODE}"),
    ("blacklisted", "kube_controller_gc_and_rq_token", f"verb IN ('create', 'get') AND resource = 'serviceaccounts' AND {by(KCM)} AND {one_of('name', COLLECTORS)}"),
]
TOGGLES = tuple(t for _, t, _ in NOISE if t)

LEASE = "resource = 'leases' AND namespace = 'kube-system'"
COLLECTOR = f"resource = 'serviceaccounts' AND namespace = 'kube-system' AND {one_of('name', COLLECTORS)}"
#: (code, predicate); 2003 and 2005 repeat 2002 and 2004 and are never reached.
CONTROL_PLANE = [
    (2000, f"{WATCH} AND {by(APISERVER)} AND {one_of('resource', CORE_WATCHED)}"),
    (2001, f"{WATCH} AND {by(KCM)} AND {one_of('resource', (*CORE_WATCHED, 'certificateigningrequests'))}"),
    (2002, f"verb = 'get' AND {by(KCM)} AND {COLLECTOR}"),
    (2004, f"verb = 'create' AND {by(KCM)} AND {COLLECTOR}"),
    (2006, f"{WATCH} AND {by(SCHEDULER)} AND resource IN ('pods', 'nodes', 'namespaces')"),
    (2007, f"{WATCH} AND {by(SCHEDULER)} AND resource = 'configmaps' AND namespace = 'kube-system' AND name = 'extension-apiserver-authentication'"),
    (2008, f"{WATCH} AND {NODE_START} AND resource = 'pods'"),
    (2009, f"{WATCH} AND {NODE_START} AND resource = 'nodes'"),
    (2010, f"{WATCH} AND {NODE_START} AND resource = 'configmaps' AND namespace = 'kube-system'"),
    (2011, f"verb = 'create' AND {NODE_START} AND resource = 'serviceaccounts' AND namespace = 'kube-system'"),
    (2012, f"verb = 'get' AND {NODE_START} AND resource = 'nodes'"),
    (2013, f"verb = 'patch' AND {NODE_START} AND resource = 'nodes'"),
    (2014, f"{WATCH} AND {by(COREDNS)} AND resource = 'namespaces'"),
    (2015, f"{WATCH} AND {by(PROXY)} AND resource = 'nodes'"),
    (2016, f"verb = 'get' AND {LEASE} AND name IN ('kube-controller-manager', 'kube-scheduler') AND username IN ('{KCM}', '{SCHEDULER}')"),
    (2017, f"verb = 'update' AND resource = 'leases' AND namespace = 'kube-node-lease' AND {NODE_START}"),
    (2018, f"verb = 'update' AND {LEASE} AND name = 'kube-controller-manager' AND {by(KCM)}"),
    (2019, f"verb = 'patch' AND resource = 'nodes' AND {by(NODE_CONTROLLER)}"),
    (2020, f"verb = 'update' AND {LEASE} AND name = 'kube-scheduler' AND {by(SCHEDULER)}"),
    (2021, f"verb = 'update' AND {LEASE} AND name LIKE 'apiserver-%' AND {by(APISERVER)}"),
]

GROUP = "user_groups LIKE '%,{},%'"
SAS, NODES = GROUP.format("system:serviceaccounts"), GROUP.format("system:nodes")
BARE = "namespace IS NULL AND name IS NULL"
#: (label or None for the proposal, predicate)
AUTO_LABEL = [
    (119232, f"{SAS} AND {LEASE} AND verb IN ('get', 'update', 'patch', 'watch')"),
    (119232, f"{by(SCHEDULER)} AND {LEASE} AND verb IN ('get', 'update', 'patch', 'watch')"),
    (None, f"{by(SCHEDULER)} AND {WATCH} AND namespace IS NULL"),
    (None, f"{by(SCHEDULER)} AND {WATCH} AND namespace = 'kube-system' AND resource = 'configmaps'"),
    (119232, f"{by(KCM)} AND {LEASE} AND verb IN ('get', 'update', 'patch')"),
    (None, f"username IN ('{APISERVER}', '{KCM}') AND {WATCH} AND {BARE}"),
    (None, f"{by(APISERVER)} AND verb = 'get' AND resource IN ('endpoints', 'endpointslices') AND namespace = 'default' AND name = 'kubernetes'"),
    (None, f"{by(APISERVER)} AND verb IN ('update', 'patch') AND {LEASE}"),
    (None, f"{by(APISERVER)} AND verb IN ('list', 'get') AND resource IN ('services', 'resourcequotas')"),
    (None, f"{by(APISERVER)} AND {WATCH} AND namespace = 'kube-system' AND resource IN ('configmaps', 'leases')"),
    (None, f"{by(APISERVER)} AND verb = 'patch' AND resource = 'secrets' AND legacy_token"),
    (61632, f"{NODES} AND resource = 'nodes' AND verb IN ('watch', 'get', 'patch')"),
    (None, f"{NODES} AND verb IN ('update', 'patch') AND resource = 'leases' AND namespace = 'kube-node-lease'"),
    (None, f"{NODES} AND {WATCH} AND {BARE}"),
    (None, f"{NODES} AND {WATCH} AND namespace = 'kube-system'"),
    (None, f"{NODES} AND verb = 'create' AND resource = 'serviceaccounts' AND subresource = 'token'"),
    (None, f"{NODES} AND verb IN ('get', 'list', 'watch') AND resource = 'configmaps' AND name = 'kube-root-ca.crt'"),
    (None, f"{by(PROXY)} AND {WATCH} AND (namespace = 'kube-system' OR namespace IS NULL)"),
    (None, f"{by(COREDNS)} AND {WATCH} AND resource IN ('services', 'namespaces', 'endpointslices') AND namespace IS NULL"),
    (17808, "resource = 'serviceaccounts' AND namespace = 'kube-system' AND (verb = 'get' OR (verb = 'create' AND subresource = 'token'))"),
    (None, f"{SAS} AND verb IN ('list', 'watch') AND {BARE}"),
]


def case(rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} THEN {o}" for o, p in rules) + f" ELSE {otherwise} END"


def noise_sql(off: tuple[str, ...] = ()) -> str:
    return case([(f"'{d}'", f"({p})") for d, t, p in NOISE if t not in off], "'whitelisted'")


def control_plane_sql() -> str:
    return case(CONTROL_PLANE, "NULL")


def auto_label_sql(strict: bool = True) -> str:
    """strict: rules 1 to 21 only see records whose namespace key is there, as the original's chain does."""
    chain = case([("proposal" if o is None else o, f"({p})") for o, p in AUTO_LABEL], "-1")
    gated = f"CASE WHEN has_namespace_key THEN {chain} ELSE -1 END" if strict else chain
    return f"CASE WHEN NOT has_ref THEN -1 WHEN proposal >= 0 AND floor(proposal / 4096) IN (666, 667) THEN proposal ELSE {gated} END"


def noise_decision(off: tuple[str, ...] = ()) -> Column:
    return F.expr(noise_sql(off))


def control_plane_code() -> Column:
    return F.expr(control_plane_sql())


def auto_label(strict: bool = True) -> Column:
    return F.expr(auto_label_sql(strict)).cast("int")


def relabelled(records: DataFrame, strict: bool = True, force: bool = False) -> DataFrame:
    """Adds new_label and new_cplabel. Wants proposal, label (null: none yet) and cplabel.

    A record that has another label keeps it unless force says otherwise; without a proposal it stays as it is.
    """
    auto, label = auto_label(strict), F.col("label")
    differs = F.coalesce(label != auto, F.lit(False))
    untouched = differs & (auto == -1)
    new = F.when(differs & ((auto == -1) | F.lit(not force)), label).otherwise(auto)
    marked = F.when(untouched, F.col("cplabel")).when(new != -1, F.lit(True)).otherwise(F.col("cplabel"))
    return records.withColumns({"new_label": new.cast("int"), "new_cplabel": marked})


# Lists that the detection rules test for.
ALLOWED_USERS = ("minikube", "minikube-user", "kubelet", "kops", "admin", "kube", "kube-proxy", "kube-apiserver-healthcheck", "kubernetes-admin", "vpa-recommender", "vpa-updater", "cluster-autoscaler", "system:addon-manager", "cloud-controller-manager", "system:kube-controller-manager")
CLOUD_USERS = ("eks:node-manager", "eks:certificate-controller", "eks:fargate-scheduler", "eks:k8s-metrics", "eks:authenticator", "eks:cluster-event-watcher", "eks:nodewatcher", "eks:pod-identity-mutating-webhook", "eks:cloud-controller-manager", "eks:vpc-resource-controller", "eks:addon-manager")
ADMIN_USERS = ("admin", "kubernetes-admin", "kubernetes-admin@kubernetes", "kubernetes-admin@cluster.local", "minikube-user")
PRIVILEGED_IMAGES = (
    "falcosecurity/falco",
    "docker.io/falcosecurity/falco",
    "public.ecr.aws/falcosecurity/falco",
    "docker.io/calico/node",
    "calico/node",
    "docker.io/cloudnativelabs/kube-router",
    "docker.io/docker/ucp-agent",
    "docker.io/mesosphere/mesos-slave",
    "docker.io/rook/toolbox",
    "docker.io/sysdig/sysdig",
    "gcr.io/google_containers/kube-proxy",
    "gcr.io/google-containers/startup-script",
    "gcr.io/projectcalico-org/node",
    "gke.gcr.io/kube-proxy",
    "gke.gcr.io/gke-metadata-server",
    "gke.gcr.io/netd-amd64",
    "gke.gcr.io/watcher-daemonset",
    "gcr.io/google-containers/prometheus-to-sd",
    "registry.k8s.io/ip-masq-agent-amd64",
    "registry.k8s.io/kube-proxy",
    "registry.k8s.io/prometheus-to-sd",
    "quay.io/calico/node",
    "sysdig/sysdig",
    "registry.k8s.io/dns/k8s-dns-node-cache",
    "mcr.microsoft.com/oss/kubernetes/kube-proxy",
)
MOUNT_IMAGES = (
    "falcosecurity/falco",
    "docker.io/falcosecurity/falco",
    "public.ecr.aws/falcosecurity/falco",
    "docker.io/sysdig/sysdig",
    "sysdig/sysdig",
    "gcr.io/google_containers/hyperkube",
    "gcr.io/google_containers/kube-proxy",
    "docker.io/calico/node",
    "docker.io/rook/toolbox",
    "docker.io/cloudnativelabs/kube-router",
    "docker.io/consul",
    "docker.io/datadog/docker-dd-agent",
    "docker.io/datadog/agent",
    "docker.io/docker/ucp-agent",
    "docker.io/gliderlabs/logspout",
    "docker.io/netdata/netdata",
    "docker.io/google/cadvisor",
    "docker.io/prom/node-exporter",
    "amazon/amazon-ecs-agent",
    "prom/node-exporter",
    "amazon/cloudwatch-agent",
)
HOST_NETWORK_IMAGES = (
    "gcr.io/google-containers/prometheus-to-sd",
    "gcr.io/projectcalico-org/typha",
    "gcr.io/projectcalico-org/node",
    "gke.gcr.io/gke-metadata-server",
    "gke.gcr.io/kube-proxy",
    "gke.gcr.io/netd-amd64",
    "registry.k8s.io/ip-masq-agent-amd64",
    "registry.k8s.io/prometheus-to-sd",
)
SYSTEM_IMAGES = (
    "gcr.io/google-containers/prometheus-to-sd",
    "gcr.io/projectcalico-org/node",
    "gke.gcr.io/addon-resizer",
    "gke.gcr.io/heapster",
    "gke.gcr.io/gke-metadata-server",
    "registry.k8s.io/ip-masq-agent-amd64",
    "registry.k8s.io/kube-apiserver",
    "gke.gcr.io/kube-proxy",
    "gke.gcr.io/netd-amd64",
    "gke.gcr.io/watcher-daemonset",
    "registry.k8s.io/addon-resizer",
    "registry.k8s.io/prometheus-to-sd",
    "registry.k8s.io/k8s-dns-dnsmasq-nanny-amd64",
    "registry.k8s.io/k8s-dns-kube-dns-amd64",
    "registry.k8s.io/k8s-dns-sidecar-amd64",
    "registry.k8s.io/metrics-server-amd64",
    "kope/kube-apiserver-healthcheck",
)
SENSITIVE_MOUNTS = ("/proc", "/var/run/docker.sock", "/", "/etc", "/root", "/var/run/crio/crio.sock", "/run/containerd/containerd.sock", "/home/admin", "/var/lib/kubelet", "/var/lib/kubelet/pki", "/etc/kubernetes", "/etc/kubernetes/manifests")
CREDENTIALS = ("aws_access_key_id", "aws-access-key-id", "aws_s3_access_key_id", "aws-s3-access-key-id", "password", "passphrase")
KNOWN_NAMESPACES = ("kube-system", "kube-public", "default")
KNOWN_ACCOUNTS = ("coredns", "coredns-autoscaler", "cronjob-controller", "daemon-set-controller", "deployment-controller", "disruption-controller", "endpoint-controller", "endpointslice-controller", "endpointslicemirroring-controller", "generic-garbage-collector", "horizontal-pod-autoscaler", "job-controller", "namespace-controller", "node-controller", "persistent-volume-binder", "pod-garbage-collector", "pv-protection-controller", "pvc-protection-controller", "replicaset-controller", "resourcequota-controller", "root-ca-cert-publisher", "service-account-controller", "statefulset-controller")
KNOWN_CLUSTER_ROLES = ("system:coredns", "system:managed-certificate-controller")
WRITING = ("create", "update", "patch", "delete", "deletecollection")

#: Columns of a record that the rules on specs test, and what they are without one.
SPEC = {"images": "array<string>", "privileged": "array<boolean>", "host_paths": "array<string>", "host_network": "boolean", "host_pid": "boolean", "host_ipc": "boolean", "service_type": "string", "config_text": "string", "has_tls": "boolean", "role_ref": "string", "rule_resources": "array<string>", "rule_verbs": "array<string>"}


def spec_columns(raw: str = "raw") -> dict[str, Column]:
    """The columns of SPEC out of the payload's requestObject; an image without its tag or digest."""
    spec = "$.requestObject.spec"

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get(raw, path, kind)

    def each(path: str, inner: str, kind: str) -> Column:
        return F.array_compact(F.transform(at(path, "array<variant>"), lambda v: F.try_variant_get(v, inner, kind)))

    def lists(inner: str) -> Column:
        return F.array_compact(F.flatten(F.filter(F.transform(at("$.requestObject.rules", "array<variant>"), lambda v: F.try_variant_get(v, inner, "array<string>")), lambda x: x.isNotNull())))

    return {
        "images": F.transform(each(f"{spec}.containers", "$.image", "string"), lambda x: F.regexp_replace(x, "(:[^/:@]*)?(@.*)?$", "")),
        "privileged": each(f"{spec}.containers", "$.securityContext.privileged", "boolean"),
        "host_paths": each(f"{spec}.volumes", "$.hostPath.path", "string"),
        "host_network": at(f"{spec}.hostNetwork", "boolean"),
        "host_pid": at(f"{spec}.hostPID", "boolean"),
        "host_ipc": at(f"{spec}.hostIPC", "boolean"),
        "service_type": at(f"{spec}.type", "string"),
        "config_text": F.to_json(at("$.requestObject.data", "variant")),
        "has_tls": at(f"{spec}.tls", "variant").isNotNull(),
        "role_ref": at("$.requestObject.roleRef.name", "string"),
        "rule_resources": lists("$.resources"),
        "rule_verbs": lists("$.verbs"),
    }


def with_spec(records: DataFrame) -> DataFrame:
    """The records with the columns of SPEC, from the payload where there is one."""
    if "raw" in records.columns:
        return records.withColumns(spec_columns())
    return records.withColumns({c: F.lit(None).cast(kind) for c, kind in SPEC.items() if c not in records.columns})


def detection_rules(allowed_users=(*ALLOWED_USERS, *CLOUD_USERS), allowed_namespaces=KNOWN_NAMESPACES, allowed_images=None, admins_allowed: bool = True, allowed_nodes=None, all_events: bool = False) -> list[tuple[str, Column]]:
    """The 48 stateless rules as (name, condition). Five hold for nothing as they come: allowed_images, admins_allowed, allowed_nodes and all_events turn them on."""
    c = F.col

    def yes(x: Column) -> Column:  # what isn't there doesn't hold
        return F.coalesce(x, F.lit(False))

    def among(x: Column, values) -> Column:
        return yes(x.isin(*values)) if values else F.lit(False)

    def trusted(values) -> Column:  # all of a pod's images, and there are some
        return yes((F.size("images") > 0) & F.forall("images", lambda x: x.isin(*values))) if values else F.lit(False)

    def has(column: str, *values) -> Column:
        return yes(F.arrays_overlap(column, F.array(*map(F.lit, values))))

    done, verb, resource, sub = yes(c("stage") == "ResponseComplete"), c("verb"), c("resource"), c("subresource")
    person = ~yes(c("username").startswith("system:"))
    fine = yes(c("code").cast("string").startswith("2"))
    created, deleted, modified, read = yes(verb == "create"), yes(verb == "delete"), among(verb, ("create", "update", "patch")), yes(verb == "get")
    is_ = {r: yes(resource == r) for r in ("deployments", "services", "configmaps", "namespaces", "serviceaccounts", "roles", "clusterroles", "rolebindings", "clusterrolebindings", "secrets", "ingresses", "nodes")}
    pods = yes(resource == "pods")
    pod, part = pods & sub.isNull(), pods & sub.isNotNull()
    role = is_["roles"] | is_["clusterroles"]
    health = F.lit(False)
    for path in ("/healthz", "/livez", "/readyz"):
        health = health | yes(c("uri") == path) | yes(c("uri").startswith(path + "?"))
    kube = among(c("namespace"), ("kube-system", "kube-public"))
    secret = F.lit(False)
    for word in CREDENTIALS:
        secret = secret | yes(c("config_text").contains(word))
    out = [
        ("Disallowed K8s User", done & person & ~among(c("username"), allowed_users)),
        ("Create Disallowed Pod", done & pod & created & (F.lit(False) if allowed_images is None else ~trusted(allowed_images))),
        ("Create Privileged Pod", done & pod & created & has("privileged", True) & ~trusted(PRIVILEGED_IMAGES)),
        ("Create Sensitive Mount Pod", done & pod & created & has("host_paths", *SENSITIVE_MOUNTS) & ~trusted(MOUNT_IMAGES)),
        ("Create HostNetwork Pod", done & pod & created & yes(c("host_network")) & ~trusted(HOST_NETWORK_IMAGES)),
        ("Create HostPid Pod", done & pod & created & yes(c("host_pid"))),
        ("Create HostIPC Pod", done & pod & created & yes(c("host_ipc"))),
        ("Create NodePort Service", done & is_["services"] & created & yes(c("service_type") == "NodePort")),
        ("Create/Modify Configmap With Private Credentials", done & is_["configmaps"] & modified & secret),
        ("Anonymous Request Allowed", done & yes(c("username") == "system:anonymous") & yes(c("decision") == "allow") & ~health),
        ("Attach/Exec Pod", yes(c("stage") == "ResponseStarted") & part & created & among(sub, ("exec", "attach"))),
        ("port-forward", yes(sub == "portforward")),
        ("EphemeralContainers Created", done & part & modified & yes(sub == "ephemeralcontainers")),
        ("Create Disallowed Namespace", done & is_["namespaces"] & created & ~among(c("name"), allowed_namespaces)),
        ("Pod Created in Kube Namespace", done & pod & created & kube & ~trusted(SYSTEM_IMAGES)),
        ("Service Account Created in Kube Namespace", done & is_["serviceaccounts"] & created & kube & fine & ~among(c("name"), KNOWN_ACCOUNTS)),
        ("System ClusterRole Modified/Deleted", done & role & (modified | deleted) & yes(c("name").startswith("system:")) & ~among(c("name"), KNOWN_CLUSTER_ROLES)),
        ("Attach to cluster-admin Role", done & is_["clusterrolebindings"] & created & yes(c("role_ref") == "cluster-admin")),
        ("ClusterRole With Wildcard Created", done & role & created & (has("rule_resources", "*") | has("rule_verbs", "*"))),
        ("ClusterRole With Write Privileges Created", done & role & created & has("rule_verbs", *WRITING)),
        ("ClusterRole With Pod Exec Created", done & role & created & has("rule_resources", "pods/exec")),
    ]
    for shown, r in (("Deployment", "deployments"), ("Service", "services"), ("ConfigMap", "configmaps"), ("Namespace", "namespaces"), ("Serviceaccount", "serviceaccounts"), ("Role", "roles"), ("ClusterRole", "clusterroles"), ("RoleBinding", "rolebindings"), ("ClusterRoleBinding", "clusterrolebindings")):
        out += [(f"K8s {shown} Created", done & created & is_[r] & fine), (f"K8s {shown} Deleted", done & deleted & is_[r] & fine & (person if r == "namespaces" else F.lit(True)))]
    outside = yes(c("namespace") != "kube-system") & person & fine  # a comparison with what isn't there doesn't hold
    stranger = F.lit(False) if allowed_nodes is None else ~among(c("name"), allowed_nodes)
    return out + [
        ("K8s Secret Created", done & created & is_["secrets"] & outside),
        ("K8s Secret Deleted", done & deleted & is_["secrets"] & outside),
        ("K8s Secret Get Successfully", done & is_["secrets"] & read & fine),
        ("K8s Secret Get Unsuccessfully Tried", done & is_["secrets"] & read & ~fine),
        ("All K8s Audit Events", done & F.lit(all_events)),
        ("Full K8s Administrative Access", done & person & among(c("username"), ADMIN_USERS) & F.lit(not admins_allowed)),
        ("Ingress Object without TLS Certificate Created", done & created & is_["ingresses"] & fine & ~yes(c("has_tls"))),
        ("Untrusted Node Successfully Joined the Cluster", done & is_["nodes"] & created & fine & stranger),
        ("Untrusted Node Unsuccessfully Tried to Join the Cluster", done & is_["nodes"] & created & ~fine & stranger),
    ]


def detected(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that hold, as an array."""
    return F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in rules]))

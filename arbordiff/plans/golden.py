"""Three-way merges of small labelled trees with known results."""

from __future__ import annotations

#: Case, tree A, tree O, tree B, result, result in patience mode (where nothing is given: a conflict).
CASES = (
    (1, "a[b,c,d]", "a[b,d]", "a[b',d]", "a[b',c,d]", "a[b',c,d]"),
    (2, "b[u[3],..]", "b[b[u[3],..],.]", "b[b[u[4],u[..]],.]", "b[u[4],u[..]]", "b[u[4],u[..]]"),
    (3, "x'[y,z]", "x[y,z]", "x[y']", "x'[y']", "x'[y']"),
    (4, "y", "x", "y", "y", "y"),
    (5, "x[k,u]", "x[u,k]", "x[y[u,k],u,k]", "x[y[k,u],k,u]", "x[u,y[u,k],k]"),
    (6, "x[u]", "x[u,k]", "x[y[u,k],u,k]", "x[y[u],u]", None),
    (7, "x[u[b],l]", "x[a,u[b],k,l]", "y[a,u[b],k,new,l]", "y[u[b],new,l]", "y[u[b],new,l]"),
    (8, "x[k,u]", "x[u,k]", "x[u,a,k]", "x[k,a,u]", "x[k,a,u]"),
    (9, "x[k,u]", "x[u,k]", "x[u',k]", "x[k,u']", "x[k,u']"),
    (10, "x[u,a,k]", "x[u,k]", "x[u,b,k]", None, None),
    (11, "x[u,a]", "x[u,b]", "x[u,c]", None, None),
    (12, "f[j]", "f[a]", "e", None, None),
    (13, "a", "d[i]", "a[j[i]]", None, None),
    (14, "l", "k[b,l]", "f[k,b]", None, None),
    (15, "g", "i[g,c]", "g[k,l]", None, None),
    (16, "j", "g[f,j]", "e[a,a,f]", None, None),
    (17, "j[f]", "e[f,f,m]", "j[g[c,c,h,f]]", "j[g[c,c,h,f]]", "j[g[c,c,h,f]]"),
    (18, "r[a,a]", "r[a,c]", "r[b,c]", "r[b,b]", "r[b,a]"),
    (19, "c[c]", "c[m[a]]", "f[c,c,c,k]", "f[c,c,c,k]", "f[c,c,c,k]"),
    (21, "x[A,N1,B,C,D,N2,E]", "x[A,B,C,D,E]", "x[B,C,D',E]", "x[N1,B,C,D',N2,E]", "x[N1,B,C,D',N2,E]"),
    (22, "x[A,N1,C,B,D,N2,E]", "x[A,B,C,D,E]", "x[B,C,D',E]", "x[N1,C,B,D',N2,E]", "x[N1,C,B,D',N2,E]"),
    (23, "x[N1,A,D[DN],C[CN],N2,B,E]", "x[A,B,C[CN],D[DN],E]", "x[A,CD[DN,CN],B,E]", None, None),
    (24, "x[A,N1,C,B,D,N2,E]", "x[A,B,C,D,E]", "x[C,B,D',E]", "x[N1,C,B,D',N2,E]", "x[N1,C,B,D',N2,E]"),
    (25, "x[A[a,c],b,B,C]", "x[A[a,b,c],B,C]", "x[A[a,c],B,b,C]", None, None),
    (26, "x[C[c],D,A,B]", "x[A,B,C[c],D]", "x[C'[c],A,B,D,E]", None, None),
    (27, "x[C,B,A]", "x[A,B,C]", "x[A',B',C']", "x[C',B',A']", "x[C',B',A']"),
)

#: One conflict of each kind: (label, grammar, mode, a, o, b), with shared parts of any height. prm-chg is not among them: a permuted variable
#: stands once on either side of a difference, so that no second finding about it can contradict the first.
CONFLICTS = [
    ("failed-contr", "rtree", "nonest", "a[b,b]", "a[d]", "a[z]"),
    ("ins-ins", "rtree", "nonest", "a[d,d]", "a[d]", "e[a,d]"),
    ("chg-dup", "rtree", "proper", "b[z]", "b[b]", "b[b,b]"),
    ("del-del", "while", "nonest", "x := a + 1;", "x := (a + 1) * (b + 2);", "x := b + 2;"),
    ("del-mod", "rtree", "patience", "c", "c[c,c]", "c[c]"),
    ("del-spn", "rtree", "nonest", "b[b]", "b[b,b]", "b[y]"),
    ("inst-contr", "rtree", "proper", "b[a,y]", "b[a]", "b"),
    ("inst-mod", "rtree", "nonest", "d", "a[d]", "a"),
    ("inst-perm", "rtree", "nonest", "b[c,b]", "b[b,c]", "b"),
    ("inst-ins", "rtree", "nonest", "c[c,c]", "c[c]", "c"),
    ("inst-del", "rtree", "nonest", "b", "b[c,b]", "b[b]"),
    ("mov-mov", "rtree", "proper", "b[a]", "b[b[a],a]", "b[b[a]]"),
    ("not-eq", "rtree", "nonest", "z", "b", "y"),
]
